"""Queries against plain Python on small tables, with nulls, empty and repeated texts, ties and odd characters."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.fixture(scope="module")
def texts():
    """Texts by id: random prose, copies, near copies, repeated lines and passages, odd ones."""
    rng = random.Random(5)
    vocabulary = [rng.choice(["the", "of", "and", "é", "straße", "an", "x", "UPPER", "12", "a|b", "#%", "<b>"]) + rng.choice(["", "er", "ing", "ñ", "."]) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(80)
    out = {i: prose(rng.choice([0, 1, 2, 3, 12, 13, 40, 120, 300])) for i in range(60)}
    for i in range(60, 75):
        out[i] = out[rng.randrange(60)]
    for i in range(75, 85):
        words = out[rng.randrange(50, 60)].split()
        if words:
            words[rng.randrange(len(words))] = "changed"
        out[i] = " ".join(words)
    for i in range(85, 95):
        out[i] = prose(50) + "\n" + passage + "\n" + prose(rng.randrange(60))
    out |= {95: None, 96: "", 97: " \t\n\r\x0b\x0c ", 98: "ab " * 400, 99: "a" * 3000, 100: "line one here\nline one here\n\n \nline one here", 101: "  word\u0085x", 102: "😀 " * 30}
    out[103] = (prose(30) + " ") * 6
    out[104] = ("é" * 450 + " ") * 2
    return out


@pytest.fixture(scope="module")
def documents(spark, texts):
    rows = [(i, t, "en", "s", None) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long").repartition(3)


def test_statistics(documents, texts):
    from siftglass.llm.quality_rules import DecisionList, quality_rules

    got = {r["doc_id"]: r for r in quality_rules(documents, DecisionList(())).collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        text = text or ""
        w = WORDS.findall(text)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        expected = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected, i
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert r["kept"] == (not r["base_failed"])


def test_substring_dedup(documents, texts, monkeypatch):
    from siftglass.llm import packed, substring_dedup

    monkeypatch.setattr(packed, "BATCH_BYTES", 4000)
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(documents, range_windows=500).collect()}
    words = {i: WORDS.findall(t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    assert len(got) == len(texts)
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), len(gone)), i
        assert got[i]["kept"] == " ".join(x for k, x in enumerate(w) if k not in gone)
        assert sum(b - a for a, b in got[i]["removed"]) == len(gone)


def brute_suffix(data, length):
    where = defaultdict(int)
    for b in data.values():
        for k in range(len(b) - length + 1):
            where[b[k : k + length]] += 1
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if where[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, kept)
    return out


@pytest.mark.parametrize(("length", "members", "hot"), [(400, 30_000, 50_000), (60, 20, 50_000), (60, 20, 6), (60, 20, 1), (400, 50, 1)])
def test_suffix_dedup(documents, texts, monkeypatch, length, members, hot):
    from siftglass.llm import packed
    from siftglass.llm.suffix_dedup import suffix_dedup

    monkeypatch.setattr(packed, "BATCH_BYTES", 6000)
    got = {r["doc_id"]: r for r in suffix_dedup(documents, length=length, range_members=members, most_members=hot).collect()}
    expected = brute_suffix({i: (t or "").encode() for i, t in texts.items()}, length)
    assert len(got) == len(texts)
    assert any(x[1] for x in expected.values())
    for i, x in expected.items():
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) == x, i


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(lowered)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(documents, texts):
    from siftglass.llm.simhash import simhash_components

    rows = simhash_components(documents).collect()
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in rows}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert got == {i: (fps[i], root(i)) for i in fps}


@pytest.mark.parametrize("members", [2, 10, 900, 10_000])
def test_simhash_links_of_lists_of_any_length(members):
    import numpy as np

    from siftglass.llm import simhash

    rng = random.Random(members)
    base = rng.getrandbits(64)
    found = set()
    while len(found) < members:
        found.add(base ^ sum(1 << b for b in rng.sample(range(16), rng.randrange(7))))
    fps = sorted(found)
    number = {f: k for k, f in enumerate(fps)}
    turns = [1 << b for b in range(16)] + [1 << a | 1 << b for a in range(16) for b in range(a)]

    def classes(pairs):
        parent = list(range(len(fps)))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in pairs:
            parent[root(number[a])] = root(number[b])
        return [root(k) for k in range(len(fps))]

    def named(labels):
        first = {}
        return [first.setdefault(x, k) for k, x in enumerate(labels)]

    near = [(f, f ^ t) for f in fps for t in turns if f ^ t in number]
    if members <= 900:
        assert {frozenset(p) for p in near} == {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}
    shuffled = fps[:]
    rng.shuffle(shuffled)
    other = [f ^ (1 << 40) for f in fps[:3]]
    lists = np.array([5] * len(fps) + [6] * len(other))
    links = simhash.forest(lists, np.array(shuffled + other, np.uint64))
    mask = (1 << 64) - 1
    own = [(a & mask, b & mask) for a, b in links if a & mask in number]
    assert all((a & mask ^ b & mask).bit_count() <= 2 for a, b in links)
    assert named(classes(own)) == named(classes(near))


def test_components_of_a_chain_and_a_hub(spark):
    from siftglass.llm.simhash import components

    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 141))
    assert all(got[i] == 7 for i in range(200, 260))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontaminate(spark, documents, texts):
    from siftglass.llm.decontaminate import decontaminate

    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    items = [(1, texts[85]), (2, texts[7] or "x"), (10, "and the"), (3, None), (4, "..."), (5, "UPPER"), (1, texts[85]), (None, "an"), (6, (texts[90] or "").upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = {}
    wins = [(str(i), w[k : k + 13]) for i, t in items if i is not None for w in [split.findall(low(t))] if w for k in range(max(1, len(w) - 12))]
    for i, t in texts.items():
        w = split.findall(low(t))
        hit, found = set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(item)
        expected[i] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    for limit in (1 << 24, 300, 1):
        got = {r["doc_id"]: r for r in decontaminate(documents, bench, pass_bytes=limit).collect()}
        assert {i: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for i, r in got.items()} == expected
        assert all(sum(b - a for a, b in r["hit_spans"]) == r["n_hit"] for r in got.values())
    none = decontaminate(documents, bench.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert none == 0


def test_token_counts(spark, documents, texts, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from siftglass.llm.token_count import CACHE, token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    extra = spark.createDataFrame([(500, "a<|endoftext|>b <|endoftext|>"), (501, None)], "doc_id long, text string")
    both = documents.select("doc_id", "text").unionByName(extra)
    tokenizer = Tokenizer.from_file(path)
    every = dict(texts) | {500: "a<|endoftext|>b <|endoftext|>", 501: None}
    expected = {i: (len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False)), n > 512) for i, t in every.items()}
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(both, path, cache).collect()}
        assert got == expected
    stored = spark.read.schema(CACHE).parquet(cache)
    assert stored.count() == len({t or "" for t in every.values()})  # the second run encoded nothing


def test_encode_decode(spark, documents, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from siftglass.llm.bpe_automaton import encode_decode

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = {500: "a<|endoftext|>B<|startoftext|> c <|endoftext", 501: "ΣΑΣ İstanbul ǅ ﬁ é 가 日本語 テスト", 502: "\x1c a\x85b\xa0c\x00\x01", 503: "it's I'LL 'S 12345 ½ ²", 504: "ab!" * 2000 + "z" * 3000, 505: "é Å"}
    extra = spark.createDataFrame(list(odd.items()), "doc_id long, text string")
    both = documents.select("doc_id", "text").unionByName(extra)
    every = dict(texts) | odd
    expected = {}
    for i, t in every.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        expected[i] = (ids, tokenizer.decode(ids, skip_special_tokens=False))
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in encode_decode(both, path).collect()}
    assert got == expected
    digests = {r["doc_id"]: r for r in encode_decode(both, path, digests=True).collect()}
    for i, (ids, decoded) in expected.items():
        assert digests[i]["n_tokens"] == len(ids)
        assert digests[i]["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert digests[i]["decoded_sha256"] == sha(decoded)


def test_automaton_accepts_exactly_the_encodings():
    from itertools import product

    from siftglass.llm.bpe_automaton import TokenAutomaton

    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "b"), ("ab", "a"), ("aa", "aa"), ("b", "aa")]
    automaton = TokenAutomaton(["a", "b"], merges)
    number = automaton.number

    def merged(word):
        parts = list(word)
        for u, v in merges:
            k = 0
            while k < len(parts) - 1:
                if parts[k] == u and parts[k + 1] == v:
                    parts[k : k + 2] = [u + v]
                k += 1
        return parts

    for n in range(1, 9):
        for word in map("".join, product("ab", repeat=n)):
            assert [automaton.labels[a] for a in automaton.path(word)] == merged(word), word
    assert not automaton.has_arc(number["a"], number["a"])


def test_chat_format(spark):
    from siftglass.llm.chat_format import format_windows, read_back

    rng = random.Random(2)
    trap = "\\### Assistant: </turn> ok"
    pieces = ["hi", trap, "### user: x</turn>\n", "\\b\\l\\h\\c", "a: b", "", "word " * 150, "é😀\n\n", "\\", "<#:"]
    conversations = {}
    for c in range(25):
        turns = [("system", rng.choice(pieces))] if c % 3 == 0 else []
        turns += [(rng.choice(["user", "assistant", "tool:x", "system"]), rng.choice(pieces)) for _ in range(rng.randrange(0, 40))]
        conversations[c] = turns
    conversations[30] = [("assistant", "word " * 2000), ("user", "x"), ("assistant", "y")]
    rows = [(c, k, r, t) for c, turns in conversations.items() for k, (r, t) in enumerate(turns)]
    rows += [(31, 0, None, None), (None, 1, "user", "q"), (None, None, "assistant", "z")]
    conversations |= {31: [("", "")], None: [("assistant", "z"), ("user", "q")]}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = format_windows(df)
    back = {r["conv_id"]: r for r in read_back(windows).collect()}
    assert set(back) == {c for c, t in conversations.items() if t}
    sizes = defaultdict(int)
    for w in windows.collect():
        sizes[w["conv_id"]] += len(w["formatted"])
        assert w["n_tokens"] <= 512 or w["conv_id"] in (30,) or max(len(t.split()) + 4 for _, t in conversations[w["conv_id"]]) > 100
        turns = conversations[w["conv_id"]]
        if w["window"] > 1 and turns[0][0] == "system":
            assert w["formatted"].startswith("### system: ")
            assert w["n_repeated"] >= 1
    for c, turns in conversations.items():
        if turns:
            assert [tuple(t) for t in back[c]["turns"]] == turns, c
            assert back[c]["loss"] == [t for r, t in turns if r == "assistant"]
            assert back[c]["formatted_chars"] == sizes[c]


def test_line_dedup(spark):
    from siftglass.llm.line_dedup import host_of, html_lines, line_dedup

    pages = [(k, f"http://A.example/{k}", f"common\nown {k}\n{'often' if k < 6 else 'rare' if k < 9 else 'x'}") for k in range(12)]
    pages += [(20, "http://b.example/1", "common\nmine"), (21, None, "common"), (22, "http://a.example/z", None), (23, "nonsense", "common"), (20, "http://b.example/1", "common\nmine")]
    df = spark.createDataFrame(pages, "page_id long, url string, text string")
    rows = line_dedup(df, host_of(F.col("url")), F.col("text")).collect()
    joined = line_dedup(df, host_of(F.col("url")), F.col("text"), broadcast_bytes=-1).collect()
    assert sorted(map(str, joined)) == sorted(map(str, rows))
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == len(pages)
    assert got[0]["text"] == "own 0" and got[0]["n_dropped"] == 2 and got[7]["text"] == "own 7\nrare"
    assert got[20]["text"] == "common\nmine" and got[21]["n_dropped"] == 0 and got[22]["text"] is None and got[22]["n_lines"] == 0
    page = spark.createDataFrame([("<p>a</p><script>x\n</script><!-- c -->b<br>",)], "h string").select(html_lines(F.col("h")).alias("t")).first()[0]
    assert page.split("\n") == ["", "a", "b", ""]


def test_learned_rules_and_classifier(spark):
    from siftglass.llm import quality_knn, quality_rules

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8)))
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        w = [word() for _ in range(rng.randrange(60, 120))]
        rows.append((i, " ".join(x.upper() + "!!" if bad else x for x in w)))
        labels.append((i, int(not bad)))
    labels += [(None, 1), (3, None), (10_000, 0)]
    documents = spark.createDataFrame(rows + [(5000, None), (5001, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    rules = quality_rules.fit(documents, marks)
    assert rules.rules
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(documents, rules).collect()}
    assert all(kept[i] == (i % 4 != 0) for i in range(900)) and not kept[5000]
    assert quality_rules.keep_good(documents, rules).count() == sum(kept.values())
    model = quality_knn.fit(documents, marks)
    got = {r["doc_id"]: r for r in quality_knn.classify(documents, model).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [i for i in range(900) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == (i % 4 != 0) for i in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = quality_knn.classify(documents, quality_knn.fit(documents, marks.limit(0)))
    assert {r["score"] for r in empty.collect()} == {0.5}
    assert not quality_rules.fit(documents, marks.limit(0)).rules


def test_native_operators_have_no_python(spark, documents):
    from siftglass.llm.chat_format import format_windows, read_back
    from siftglass.llm.quality_rules import DecisionList, quality_rules

    talks = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    for df in (quality_rules(documents, DecisionList(())), read_back(format_windows(talks))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_tables_nulls_and_clashing_names(spark):
    import public_tokenizers

    from siftglass.llm.bpe_automaton import encode_decode
    from siftglass.llm.decontaminate import decontaminate, drop_contaminated
    from siftglass.llm.quality_rules import DecisionList, keep_good, quality_rules
    from siftglass.llm.simhash import near_dedup, simhash_components
    from siftglass.llm.substring_dedup import substring_dedup
    from siftglass.llm.suffix_dedup import suffix_dedup

    schema = "doc_id long, text string, id long, batch string, key string, fp string, words string, stats string, `h` int, c0 int, k int"
    rest = (1, "b", "k", "f", "w", "s", 4, 5, 6)
    full = spark.createDataFrame([(None, None, *rest), (None, None, *rest), (3, "a b c", *rest), (3, "a b c", *rest), (4, "z " * 60, *rest)], schema)
    bench = spark.createDataFrame([(1, "q")], "item_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    for df, n in ((full, 5), (full.limit(0), 0)):
        for out in (
            quality_rules(df, DecisionList(())),
            simhash_components(df),
            decontaminate(df, bench),
            substring_dedup(df),
            suffix_dedup(df),
            encode_decode(df, path),
        ):
            assert out.count() == n
        kept = near_dedup(df)
        assert kept.columns == df.columns and kept.count() == (3 if n else 0)
        assert drop_contaminated(df, bench).columns == df.columns
        assert keep_good(df, DecisionList(())).columns == df.columns
