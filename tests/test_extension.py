"""Detectors of one's own, and functions by name in SQL."""

import zlib

from pyspark.sql import functions as F

from siftglass.functions.extension import register
from siftglass.operators.artifacts import artifacts_from_text
from siftglass.operators.inspect import Detector, findings
from siftglass.operators.report import analyze
from siftglass.operators.text_findings import finding


class Shouting:
    """Texts with words of capitals; knows nothing of texts that it doesn't apply to."""

    name = "shouting"

    def applies(self):
        return F.length("text") > 3

    def findings(self):
        n = F.regexp_count("text", F.lit("\\b[A-Z]{3,}\\b"))
        return F.when(n > 0, F.array(finding(self.name, "capitals", "notice", "words in capitals", n)))


def test_detector_of_ones_own(spark):
    rows = [(1, "STOP this NOW"), (2, "quiet text"), (3, "ABC"), (4, None), (1, "STOP\u200b here")]
    artifacts = artifacts_from_text(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert isinstance(Shouting(), Detector)
    found = [(r["artifact_id"], r["category"], r["count"]) for r in findings(artifacts, [Shouting()]).collect()]
    assert sorted(found) == [(1, "capitals", 1), (1, "capitals", 2), (1, "zero_width", 1)]
    reports = analyze(artifacts, extra=[Shouting()]).collect()
    assert len(reports) == 4  # a null text is no artifact
    assert {(r["artifact_id"], r["inspectors"][-1]["name"], r["inspectors"][-1]["ran"]) for r in reports} == {
        (1, "shouting", True), (2, "shouting", True), (3, "shouting", False),
    }
    assert all((x["reason"] is None) == x["ran"] for r in reports for x in r["inspectors"])
    plain = analyze(artifacts).collect()
    assert all(r["inspectors"][-1]["name"] != "shouting" for r in plain) and len(plain) == 4


def test_functions_in_sql(spark):
    names = register(spark)
    assert len(names) == len(set(names)) == 8
    row = spark.sql(
        "SELECT siftglass_nfc(t) AS nfc, siftglass_nfc(CAST(NULL AS STRING)) AS none, siftglass_normal_form(t) AS form,"
        " siftglass_normal_form('abc') AS composed, siftglass_word_similarity(array('a', 'b'), array('a', 'c')) AS alike, siftglass_pixel_digest(CAST('no image' AS BINARY)) AS pixels,"
        " siftglass_pdf_fields(CAST(NULL AS BINARY)) AS fields FROM (SELECT decode(unhex('63616665CC81'), 'UTF-8') AS t)"
    ).first()
    assert tuple(row) == ("caf\u00e9", None, "NFD", None, 0.5, None, None)


def test_table_functions_in_sql(spark):
    register(spark)
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"tEXt", b"a\0b") + chunk(b"IEND", b"") + b"tail"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xfe\x00\x05xyz\xff\xda\x00\x02"
    spark.createDataFrame([(1, png), (2, png[:18]), (3, jpeg), (4, None), (5, b""), (6, b"PK\x03\x04 broken"), (7, png[:20])], "id int, data binary").createOrReplaceTempView("extension_files")
    ask = lambda name: sorted(map(tuple, spark.sql(f"SELECT id, t.* FROM extension_files, LATERAL siftglass_{name}(data) t").collect()))
    assert ask("png_chunks") == [(1, 0, "tEXt", 3), (1, 1, "IEND", 0), (7, 0, "tEXt", 3)]
    assert ask("jpeg_segments") == [(3, 0, 0xE0, 2), (3, 1, 0xFE, 3)]
    assert ask("office_parts") == []


def test_labels_stand_where_hidden_characters_stood(spark):
    from siftglass.functions.wording import labelled, revealed, severity_words, title

    rows = [("a\u200bb\u00a0c\x07\n\t",), ("\ufeff\u200b\U000e0041\ufe0f",), ("plain",), ("",), (None,)]
    text, name = F.col("text"), F.lit("no_such_category")
    got = spark.createDataFrame(rows, "text string").select(revealed(text), labelled(text), title(name), severity_words(F.lit("info"))).collect()
    assert [r[0] for r in got] == [
        "a\u27e6ZWSP\u27e7b\u27e6NBSP\u27e7c\u27e6CTRL\u27e7\n\t", "\u27e6BOM\u27e7\u27e6ZWSP\u27e7\u27e6TAG\u27e7\u27e6VS\u27e7", "plain", "", None,
    ]
    assert [[tuple(x) for x in r[1]] for r in got] == [
        [("ZWSP", 1), ("NBSP", 1), ("CTRL", 1)], [("ZWSP", 1), ("BOM", 1), ("TAG", 1), ("VS", 1)], [], [], [],
    ]
    assert {tuple(r[2:]) for r in got} == {("no_such_category", "Good to know")}
