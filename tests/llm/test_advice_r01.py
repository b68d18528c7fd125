"""Cases of the first review that the operators once left out."""


def test_line_stage_leaves_copies_their_text(spark):
    import corpus_pipeline

    copied = "first line of the copies\nsecond line of the copies"
    shuffled = "second line of the copies\nfirst line of the copies\n"
    rows = [(k, f"own {k}\nfooter", "en", "s", 0) for k in range(40)]
    rows += [(100 + k, copied, "en", "s", 0) for k in range(8)]
    rows += [(200 + k, f"{shuffled}{'\n' * k}", "en", "s", 0) for k in range(8)]
    rows += [(300, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.line_stage(spark, df, "").collect()}
    assert len(got) == len(rows) and got[300]["text"] is None
    assert all(got[k]["text"] == f"own {k}" for k in range(40))  # what is boilerplate still goes
    assert all(got[i]["text"] == t and got[i]["n_chars"] == len(t) for i, t, *_ in rows if 100 <= i < 300)
    left = corpus_pipeline.near_dedup_stage(spark, df.where("doc_id between 100 and 199"), "").collect()
    assert [r["text"] for r in left] == [copied]


def test_repeated_windows_parted_by_an_equal_key(spark):
    from pyspark.sql import functions as F

    from siftglass.llm.quality_rules import statistics

    n = (1 << 20) + 2
    words = [f"{k:x}" for k in range(n)]
    word = lambda c: F.lower(F.hex(c))
    digests = spark.range(n - 2).select("id", F.xxhash64(*[word(F.col("id") + j) for j in range(3)]).alias("x"))
    keyed = digests.groupBy(F.shiftright("x", 31)).agg(F.sort_array(F.collect_list("id")).alias("at")).where("size(at) > 1")
    first, second = min(keyed.collect(), key=lambda r: r["at"])["at"][:2]
    text = " ".join(words[first : second + 3] + words[first : first + 3])
    padding = " ".join(f"p{k:x}" for k in range(n - len(text.split())))
    df = spark.createDataFrame([(1, f"{padding} {text}")], "doc_id long, text string")
    assert statistics(df).first()["stats"]["n_repeat_words"] == 6


def test_items_without_id_contaminate(spark):
    from siftglass.llm.decontaminate import decontaminate, drop_contaminated

    passage = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(1, f"before {passage} after"), (2, "clean words")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (7, "other item")], "item_id long, text string")
    for limit in (1 << 24, 10):
        assert [r["doc_id"] for r in drop_contaminated(df, bench, pass_bytes=limit).collect()] == [2]
    r = decontaminate(df, bench, null_items=True).where("doc_id = 1").first()
    assert (r["n_hit"], r["items"], r["contaminated"]) == (20, [], True)
