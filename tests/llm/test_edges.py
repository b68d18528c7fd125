"""Nulls, empty tables, clashing names, repeated rows and very long texts, operator by operator and stage by stage."""

import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(5000)]
    head = " ".join(rng.choice(words) for _ in range(150_000))
    return head + " " + head[:2000] + " " + "x" * 100_000


def test_very_long_text(spark, long_text):
    import public_tokenizers

    from siftglass.llm.bpe_automaton import encode_decode
    from siftglass.llm.decontaminate import decontaminate
    from siftglass.llm.quality_rules import DecisionList, quality_rules
    from siftglass.llm.simhash import simhash_components
    from siftglass.llm.substring_dedup import substring_dedup
    from siftglass.llm.suffix_dedup import suffix_dedup
    from siftglass.llm.token_count import token_counts

    df = spark.createDataFrame([(1, long_text), (2, long_text[5000:9000])], "doc_id long, text string")
    n = len(long_text.split())
    assert quality_rules(df, DecisionList(())).where("doc_id = 1").first()["n_words"] == n
    assert substring_dedup(df).where("doc_id = 2").first()["n_removed"] > 300
    got = {r["doc_id"]: r for r in suffix_dedup(df).collect()}
    assert got[2]["n_removed"] == 4000 and got[1]["n_removed"] >= 4000 + 2 * 2000 + 100_000
    assert simhash_components(df).count() == 2
    bench = spark.createDataFrame([(1, " ".join(long_text.split()[100_000:100_050]))], "item_id long, text string")
    assert decontaminate(df, bench).where("doc_id = 1").first()["n_hit"] == 50
    assert encode_decode(df, public_tokenizers.path("word_bpe_49k.json"), digests=True).where("n_tokens > 150000").count() == 1
    cache = spark.conf.get("spark.sql.warehouse.dir") + "/long_cache"
    assert token_counts(df, public_tokenizers.path("byte_bpe_50k.json"), cache).where("over_limit").count() == 2


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, id long, host string, common string, kept string, content string, n_tokens long, stats string, c string, window long, k0 string"


def clashing(spark, texts):
    return spark.createDataFrame([(k, t, "en", s, 1, 2, "h", "c", "k", "d", 3, "s", "c", 4, "z") for k, t, s in texts], CLASHING)


@pytest.mark.parametrize("texts", [[], [(1, None, None), (None, None, None), (2, "", "s"), (2, "", "s"), (3, "a b\nc", None), (4, "a b\nc", "s")]])
def test_clashing_names_and_nulls(spark, texts):
    import public_tokenizers

    from siftglass.llm import quality_knn
    from siftglass.llm.line_dedup import line_dedup
    from siftglass.llm.token_count import token_counts

    df = clashing(spark, texts)
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, None)], "doc_id long, quality int")
    assert quality_knn.classify(df, quality_knn.fit(df, labels)).count() == len(texts)
    out = line_dedup(df, F.col("source"), F.col("text"), "doc_id", keep=["lang", "id", "common"])
    assert out.columns == ["doc_id", "lang", "id", "common", "n_lines", "n_dropped", "text"] and out.count() == len(texts)
    cache = f"{spark.conf.get('spark.sql.warehouse.dir')}/clash_cache_{len(texts)}"
    counts = token_counts(df, public_tokenizers.path("byte_bpe_50k.json"), cache)
    assert sorted(r["n_bytes"] for r in counts.collect()) == sorted(len(t or "") for _, t, _ in texts)


def test_chat_edges(spark):
    from siftglass.llm.chat_format import format_windows, read_back

    schema = "conv_id long, turn long, role string, text string, c long, t long, window long, tokens long, at long, parts string"
    rows = [(1, 0, "user", "a", *[9] * 5, "p"), (1, 0, "user", "a", *[9] * 5, "p"), (2, None, None, None, *[9] * 5, "p")]
    for some, n in ((rows, 2), ([], 0)):
        back = {r["conv_id"]: r for r in read_back(format_windows(spark.createDataFrame(some, schema))).collect()}
        assert len(back) == n
    back = {r["conv_id"]: r for r in read_back(format_windows(spark.createDataFrame(rows, schema))).collect()}
    assert back[1]["n_turns"] == 2 and [tuple(t) for t in back[2]["turns"]] == [("", "")]


def test_window_budget(spark):
    from siftglass.llm.chat_format import format_windows

    rows = [(1, 0, "system", "be kind")] + [(1, k, ("user", "assistant")[k % 2], "w " * (k * 7 % 90)) for k in range(1, 120)]
    rows += [(2, k, "user", "") for k in range(3000)]
    windows = format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(w["n_tokens"] <= 512 for w in windows)
    assert len(windows) > 20 and all(w["n_repeated"] < w["n_turns"] for w in windows)


def test_decision_list_learns_conjunctions():
    from siftglass.llm.quality_rules import learn

    cells = [((a, b), 40 if a > 2 and b <= 1 else 0, 0 if a > 2 and b <= 1 else 40) for a in range(5) for b in range(5)]
    found = learn(cells, cells, {"words": [0.0, 1.0, 2.0, 3.0], "repeated_words": [0.0, 1.0, 2.0, 3.0]})
    assert len(found.rules) == 1
    assert {str(c) for c in found.rules[0]} == {"words > 2", "repeated_words <= 1"}
    noisy = [((a, 0), 20, 20) for a in range(3)]
    assert not learn(noisy, noisy, {"words": [0.0, 1.0], "repeated_words": [0.0]}).rules


def brute_pipeline(rows, labels, items):
    """The last four stages in plain Python, from what the rules kept."""
    import re
    from collections import Counter, defaultdict

    from siftglass.llm.decontaminate import Searcher
    from siftglass.llm.simhash import fingerprint

    total, seen = Counter(r[3] for r in rows if r[3] is not None), defaultdict(Counter)
    for r in rows:
        if r[3] is not None and r[1] is not None:
            seen[r[3]].update({x.strip(" ") for x in r[1].split("\n")} - {""})
    cut = {}
    for i, t, _, s, _ in rows:
        common = {x for x, n in seen[s].items() if n >= 5 and n / total[s] > 0.05} if s is not None else set()
        cut[i] = None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in common)
    fps = {i: fingerprint((t or "").encode()) for i, t in cut.items()}
    parent = {i: i for i in fps}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    left = [i for i in cut if root(i) == i]
    searcher = Searcher([(str(k), t.encode()) for k, t in items])
    out = {}
    for i in left:
        _, hit, _ = searcher.scan((cut[i] or "").encode())
        if not hit.any():  # all items are longer than a window: one occurrence is enough, in a text of any length
            out[i] = cut[i]
    windows = {tuple(w[k : k + 13]) for _, t in items for w in [re.findall("[a-z0-9]+", t)] for k in range(len(w) - 12)}
    for t in out.values():
        w = re.findall("[a-z0-9]+", (t or "").lower())
        assert not windows & {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from siftglass.llm.quality_rules import DecisionList, fit, quality_rules

    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, prose(30)) for k in range(5)]
    rows = []
    for i in range(160):
        text = prose(rng.randrange(40, 160))
        if i % 9 == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i % 7 == 2:
            text += "\n" + items[i % 5][1]
        if i % 20 == 15:  # a passage that is far below a twentieth of its text
            text += "\n" + prose(600) + "\n" + " ".join(items[i % 5][1].split()[5:20])
        if i % 2:
            text += "\nall rights reserved by the site"
        if i % 11 == 3 and i > 20:
            text = rows[i - 20][1]
        rows.append((i, text, "en", rng.choice(["s", "t", None]), len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 != 1)) for i in range(160)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    documents, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rules = fit(documents, labels)
    kept = {r["doc_id"] for r in quality_rules(documents, rules).where("kept").collect()}
    assert kept < {r["doc_id"] for r in quality_rules(documents, DecisionList(())).where("kept").collect()}
    expected = brute_pipeline([r for r in rows if r[0] in kept], labels, items)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(expected) and len(got) < len(kept)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in expected.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), i
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == documents.columns and docs.schema.simpleString() == documents.schema.simpleString()
    empty = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
