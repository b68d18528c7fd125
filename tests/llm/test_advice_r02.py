"""Cases of the second review."""


def test_benchmark_of_many_groups(spark):
    from siftglass.llm.decontaminate import decontaminate, drop_contaminated

    passage = lambda k: " ".join(f"p{k}w{j}" for j in range(15))
    bench = spark.createDataFrame([(k, passage(k)) for k in range(100)], "item_id long, text string").repartition(3)
    texts = [(k, f"before {passage(k)} between {passage((k + 7) % 100)} after") for k in range(100)]
    texts += [(k, "clean " * k) for k in range(200, 210)] + [(7, texts[7][1]), (None, texts[3][1]), (300, None), (301, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    one = sorted(map(str, decontaminate(df, bench).collect()))
    assert one == sorted(map(str, decontaminate(df, bench, pass_bytes=800).collect()))
    r = decontaminate(df, bench, pass_bytes=800).where("doc_id = 5").first()
    assert (r["n_hit"], r["items"], r["contaminated"]) == (30, ["12", "5"], True)
    kept = [r["doc_id"] for r in drop_contaminated(df, bench, pass_bytes=800).collect()]
    assert sorted(kept) == [*range(200, 210), 300, 301]


def test_passage_in_a_long_text_goes_but_a_short_item_does_not(spark):
    from siftglass.llm.decontaminate import drop_contaminated

    passage = " ".join(f"w{k}" for k in range(13))
    filler = "filler " * 5000
    df = spark.createDataFrame([(1, f"{filler}{passage} {filler}"), (2, filler + "capital of france"), (3, "the capital of france"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage + " more"), (2, "capital of France")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in drop_contaminated(df, bench).collect()) == [2, 4]


def test_budget_holds_with_any_system_turn(spark):
    import random

    from siftglass.llm.chat_format import format_windows, read_back

    rng = random.Random(6)
    cases = {0: [("system", 64), ("user", 128), ("assistant", 191), ("user", 192), ("assistant", 100)]}
    for c in range(1, 60):
        system = rng.choice([0, 4, 30, 200, 400])
        most = 512 - system
        turns = [("system", system)] if system else []
        cases[c] = turns + [(rng.choice(["user", "assistant"]), rng.randint(4, rng.choice([20, 200, most]))) for _ in range(rng.randrange(1, 80))]
    rows = [(c, k, role, f"t{k} " + "w " * (n - 5) if n > 4 else "", n) for c, turns in cases.items() for k, (role, n) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    for windows in (format_windows(df), format_windows(df.withColumn("text", F_lit_short()), tokens_col="n")):
        got = windows.collect()
        for w in got:
            turns = cases[w["conv_id"]]
            if (turns[0][1] if turns[0][0] == "system" else 0) + max(n for _, n in turns) <= 512:
                assert w["n_tokens"] <= 512
            assert w["n_repeated"] < w["n_turns"]
    full = format_windows(df)
    back = {r["conv_id"]: r for r in read_back(full).collect()}
    assert all(back[c]["n_turns"] == len(turns) for c, turns in cases.items())
    even = spark.createDataFrame([(1, k, "user", "w " * 16) for k in range(400)], "conv_id long, turn long, role string, text string")
    sizes = [w["n_tokens"] for w in format_windows(even).collect()]
    assert sorted(sizes)[1:] == [500] * (len(sizes) - 1) and max(w["n_repeated"] for w in format_windows(even).collect()) == 6


def F_lit_short():
    from pyspark.sql import functions as F

    return F.lit("short")


def test_second_run_of_the_query_encodes_nothing(spark, monkeypatch):
    from siftglass.llm import queries, token_count

    data = "/root/testdata/sf0.001"
    first = sorted(map(str, queries.op4_token_counts(spark, data).collect()))
    stored = spark.read.parquet(token_count.cache_of(spark, data)).count()

    def encode(texts, path):
        raise AssertionError("nothing is left to encode")

    monkeypatch.setattr(token_count, "_encode", encode)
    assert sorted(map(str, queries.op4_token_counts(spark, data).collect())) == first
    assert spark.read.parquet(token_count.cache_of(spark, data)).count() == stored


def test_line_ends_and_small_hosts(spark):
    from pyspark.sql import functions as F

    from siftglass.llm.line_dedup import line_dedup

    rows = [(k, "a", f"menu{'\r' * (k % 2)}\nown {k}\r\n\t\n \x0b ") for k in range(8)]
    rows += [(10 + k, "b", f"menu\nown {k}") for k in range(3)] + [(20 + k, "c", f"menu\nown {k}" if k else "own") for k in range(4)]
    rows += [(30 + k, "d", "same\nlines") for k in range(2)] + [(40 + k, "e", f"menu\nown {k}" if k < 2 else "own") for k in range(4)]
    df = spark.createDataFrame(rows, "page_id long, host string, text string")
    got = {r["page_id"]: r for r in line_dedup(df, F.col("host"), F.col("text")).collect()}
    assert all(got[k]["n_dropped"] == 1 and got[k]["n_lines"] == 2 for k in range(8))
    assert all(got[10 + k]["text"] == f"own {k}" for k in range(3))
    assert all("menu" not in got[20 + k]["text"] for k in range(4))
    assert all(got[k]["n_dropped"] == 0 for k in (30, 31, 40, 41))


def test_registered_queries_against_their_sql(spark):
    import duckdb

    from siftglass.llm import queries

    data = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        result = connection.execute(sql)
        names = [d[0] for d in result.description]
        expected = sorted(str([r[names.index(n)] for n in sorted(names)]) for r in result.fetchall())
        df = queries.queries()[name](spark, data)
        assert sorted(df.columns) == sorted(names)
        assert sorted(str([r[n] for n in sorted(names)]) for r in df.collect()) == expected, name


def test_scores_are_those_of_brute_force_voting(spark):
    import math
    import random

    import numpy as np

    from siftglass.llm import quality_knn as Q

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    texts = {i: " ".join(word() for _ in range(rng.randrange(5, 60))) for i in range(300)}
    texts |= {400: None, 401: "", 402: "abc", 403: "日本語テキスト"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = Q.fit(df, spark.createDataFrame([(i, i % 3 % 2) for i in range(200)], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in Q.classify(df, model).collect()}
    assert set(got) == set(texts)
    points, labels = model.points.astype(float).tolist(), model.labels.tolist()
    for i, text in texts.items():
        row = model.project(Q.terms((text or "").encode())[None])[0].astype(float)
        cosines = [sum(a * b for a, b in zip(row, p)) for p in points]
        nearest = sorted(range(len(points)), key=lambda k: -cosines[k])[: Q.NEIGHBOURS]
        weights = [max(cosines[k], 0) ** Q.SHARPNESS for k in nearest]
        total = sum(weights)
        expected = sum(w * labels[k] for w, k in zip(weights, nearest)) / total if total > 1e-9 else sum(labels) / len(labels)
        assert math.isclose(got[i], expected, abs_tol=1e-3), i
    same_shape = [Q.terms(t)[None] for t in (b"good words in here", b"evil wards on hare")]
    assert np.array_equal(same_shape[0][:, : Q.COLUMNS], same_shape[1][:, : Q.COLUMNS])
    assert not np.allclose(same_shape[0], same_shape[1])
