"""Texts: findings, operations, checks and decisions, against hand-made expectations and plain Python."""

import difflib
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from siftglass.functions import charsets as C
from siftglass.functions.cleaning import OPERATIONS, PROFILES, cleaned, resolve_operations

DIRTY = "﻿# Title​\r\n\r\nSome text ‎here  \n\n\n\n\nend\U000e0048\U000e0049"
SAMPLES = [
    "# Heading\n\nPlain paragraph.\n\n- one\n- two\n", "", "no newline", DIRTY, "a​b‌c‍d⁠e᠎f﻿g", "﻿﻿x",
    "x‪‫‬‭‮⁦⁧⁨⁩؜‎‏y", "a b c　d", "so­ft͏cgj⠀blank", "emoji️\U000e0100", "bell\x07\x00\x85z",
    "a\rb", "a\r\nb\nc\rd", "café e‍́", "1.", "text\n-", "tail \t \nmore\t\n", "a\n\n\n\n\n\nb", "\U000e0001\U000e0041", "pаypal µm ΑΒ日本 aб",
    "😀​😀\n​x",
]


@pytest.fixture(scope="module")
def samples(spark):
    from siftglass.operators.artifacts import artifacts_from_text

    rows = list(enumerate(SAMPLES)) + [(1000, None)]
    return artifacts_from_text(spark.createDataFrame(rows, "id long, text string"), "id", "text")


def drop(text, points):
    return "".join(c for c in text if ord(c) not in points)


def apply_plainly(name, t):
    match name:
        case "strip_zero_width":
            return (C.BOM if t.startswith(C.BOM) else "") + drop(t, C.ZERO_WIDTH)
        case "strip_tag_characters":
            return drop(t, range(0xE0000, 0xE0080))
        case "strip_bidi_controls":
            return drop(t, C.BIDI_CONTROLS)
        case "strip_variation_selectors":
            return drop(t, {*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)})
        case "strip_other_invisible":
            return drop(t, C.OTHER_INVISIBLE)
        case "strip_control_characters":
            return "".join(c for c in t if unicodedata.category(c) != "Cc" or c in "\n\r\t")
        case "normalize_spaces":
            return "".join(" " if ord(c) in C.EXOTIC_SPACES else c for c in t)
        case "strip_bom":
            return t.removeprefix(C.BOM)
        case "normalize_nfc":
            return unicodedata.normalize("NFC", t)
        case "normalize_line_endings":
            return t.replace("\r\n", "\n").replace("\r", "\n")
        case "strip_trailing_whitespace":
            return "\n".join(x.rstrip(" \t") for x in t.split("\n"))
        case "collapse_blank_lines":
            return re.sub("\n{4,}", "\n\n\n", t)
        case "ensure_final_newline":
            return t if not t or t[-1] == "\n" else t + "\n"
    raise AssertionError(name)


def plainly(text, names):
    for n in names:
        if n != "remove_unused_imports":
            text = apply_plainly(n, text)
    return text


def skeleton(t):
    kept = "".join(c for c in unicodedata.normalize("NFC", t) if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t")
    return " ".join(kept.split())


def structure(t):
    view = "".join(c for c in t if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t")
    return [len(re.findall(p, view, re.M)) for p in (r"^\s{0,3}#{1,6}\s", r"^\s*(?:```|~~~)", r"^\s*(?:[-*+]|\d+\.)\s")]


@pytest.mark.parametrize("name", [n for n, o in OPERATIONS.items() if o.apply])
def test_operation(samples, name):
    got = {r[0]: r[1] for r in samples.where("text IS NOT NULL").select("artifact_id", cleaned(F.col("text"), name)).collect()}
    assert got == {k: apply_plainly(name, SAMPLES[k]) for k in got}


@pytest.mark.parametrize("profile", list(PROFILES))
def test_profile_and_acceptance(samples, profile):
    from siftglass.operators.transform import Options, transform_text

    for r in transform_text(samples, Options(profile=profile)).collect():
        before = SAMPLES[r["artifact_id"]]
        after = plainly(before, PROFILES[profile])
        good = skeleton(before) == skeleton(after) and structure(before) == structure(after)
        assert r["accepted"] == good, before
        assert bytes(r["output"]).decode() == (after if good else before)
        assert [c["name"] for c in r["checks"]] == ["visible_content_preserved", "no_unintended_additions", "lexical_similarity", "structure_preserved", "semantic_similarity"]
        measured = json.loads(r["checks"][0]["measurements"])
        assert measured == {"skeleton_chars_before": len(skeleton(before)), "skeleton_chars_after": len(skeleton(after))}
        ratio = difflib.SequenceMatcher(a=skeleton(before).split(), b=skeleton(after).split(), autojunk=False).ratio()
        assert json.loads(r["checks"][2]["measurements"])["ratio"] == pytest.approx(ratio, abs=1e-6)
        current = before
        for o in r["operations"]:
            if o["operation"] == "remove_unused_imports":
                continue
            fresh = apply_plainly(o["operation"], current)
            steps = difflib.SequenceMatcher(a=current, b=fresh, autojunk=False).get_opcodes()
            assert o["changes"] == sum(max(b - a, d - c) for t, a, b, c, d in steps if t != "equal"), (o["operation"], current)
            assert o["applied"] == (fresh != current)
            current = fresh


def test_resolve():
    assert [o.id for o in resolve_operations("minimal", [])] == PROFILES["minimal"]
    assert [o.id for o in resolve_operations("minimal", ["strip_bom", "normalize_nfc"])] == ["strip_bom", "normalize_nfc"]
    with pytest.raises(KeyError, match="a, z"):
        resolve_operations(None, ["z", "strip_bom", "a"])
    with pytest.raises(KeyError, match="code, minimal, standard, tidy"):
        resolve_operations("nope")


def test_text_findings(samples):
    from siftglass.operators.text_findings import text_findings

    got = {}
    for r in text_findings(samples).collect():
        got.setdefault(r["artifact_id"], {})[r["category"]] = r
    sets = {"zero_width": C.ZERO_WIDTH, "bidi_control": C.BIDI_CONTROLS, "exotic_space": C.EXOTIC_SPACES, "other_invisible": C.OTHER_INVISIBLE}
    for k, text in enumerate(SAMPLES):
        if "\0" in text:
            continue  # binary
        for category, points in sets.items():
            hits = [i for i, c in enumerate(text) if ord(c) in points and not (i == 0 and c == C.BOM)]
            r = got.get(k, {}).get(category)
            assert (r["count"] if r else 0) == len(hits), (text, category)
            if hits:
                assert [p["offset"] for p in r["locations"]] == hits
                for p in r["locations"]:
                    before = text[: p["offset"]]
                    assert (p["line"], p["column"]) == (before.count("\n") + 1, len(before) - before.rfind("\n"))
                assert json.loads(r["details"])["codepoints"] == sorted({f"U+{ord(text[i]):04X}" for i in hits})
        assert ("unicode_normalization" in got.get(k, {})) == (not unicodedata.is_normalized("NFC", text))
        assert ("byte_order_mark" in got.get(k, {})) == text.startswith(C.BOM)
    tags = got[SAMPLES.index(DIRTY)]["unicode_tag_char"]
    assert json.loads(tags["details"])["decoded_ascii_payload"] == "HI"
    mixed = got[SAMPLES.index("pаypal µm ΑΒ日本 aб")]["mixed_script_word"]
    assert json.loads(mixed["details"])["examples"] == ["pаypal", "µm", "aб"] and mixed["count"] == 3
    assert 0 not in got and 1 not in got and 10 not in got


def test_many_hits_and_comments(spark):
    from siftglass.operators.artifacts import artifacts_from_text
    from siftglass.operators.text_findings import text_findings

    rows = [(1, "​x\n" * 80), (2, "<!-- a\n  b -->é<!---->\n<!--" + "w" * 400 + "--> <!-- open"), (3, "<!-- c -->")]
    artifacts = artifacts_from_text(spark.createDataFrame(rows, "id long, text string"), "id", "text", F.when(F.col("id") == 3, "x.py"))
    got = {r["artifact_id"]: r for r in text_findings(artifacts).collect()}
    assert got[1]["count"] == 80 and len(got[1]["locations"]) == 50
    assert [(p["offset"], p["line"]) for p in got[1]["locations"]] == [(3 * i, i + 1) for i in range(50)]
    places = got[2]["locations"]
    assert [(p["offset"], p["line"], p["column"], p["length"], p["excerpt"]) for p in places] == [(0, 1, 1, 14, "a b"), (15, 2, 9, 7, ""), (23, 3, 1, 407, "w" * 160)]
    assert 3 not in got  # comments in source code are code


def test_classification(spark):
    from siftglass.operators.artifacts import artifacts_from_binary

    rows = [
        (0, "a/b.PY", b"x"), (1, "a.b/c", b"x"), (2, ".py", b"x"), (3, "a.py", b"\xff"), (4, "x.tar.JPEG", b"\xff\xd8"), (5, None, b"\xef\xbb\xbfhi"),
        (6, "n.txt", b"a\0b"), (7, "n.txt", b"a" * 8192 + b"\0"), (8, "x.", b""), (9, "d.md/", b""),
    ]
    df = spark.createDataFrame([(k, p, bytearray(d)) for k, p, d in rows] + [(10, "null", None)], "id long, path string, data binary")
    got = {r["artifact_id"]: (r["kind"], r["language"], r["media_type"], r["encoding"]) for r in artifacts_from_binary(df, "id", "data", "path").collect()}
    assert got == {
        0: ("source_code", "python", None, "utf-8"), 1: ("text", None, None, "utf-8"), 2: ("text", None, None, "utf-8"), 3: ("binary", None, None, None),
        4: ("binary", None, "image/jpeg", None), 5: ("text", None, None, "utf-8-sig"), 6: ("binary", None, "text/plain", None),
        7: ("text", None, "text/plain", "utf-8"), 8: ("text", None, None, "utf-8"), 9: ("text", None, "text/markdown", "utf-8"),
    }


def test_pairs(spark):
    from siftglass.operators.checks import validate_pairs

    rows = [(1, "the cat sat", "the  cat\nsat"), (2, "the cat sat", "the dog sat"), (3, "# h\ntext", "h\ntext"), (4, None, "x"), (5, "", "")]
    got = {r["id"]: r for r in validate_pairs(spark.createDataFrame(rows, "id long, a string, b string"), "id", "a", "b").collect()}
    assert [got[k]["all_passed"] for k in range(1, 6)] == [True, False, False, None, True]
    passed = {c["name"]: c["passed"] for c in got[2]["checks"]}
    assert passed == {"visible_content_preserved": False, "no_unintended_additions": False, "lexical_similarity": False, "structure_preserved": True, "semantic_similarity": None}


def test_code_decisions(spark):
    from siftglass.operators.artifacts import artifacts_from_text
    from siftglass.operators.transform import BROKEN, CHANGED, UNPROVEN, Options, transform

    rows = [(1, "a.py", "x = 1  \n"), (2, "b.py", "x = 'a​b'\n"), (3, "c.kt", "val x = 1  \n"), (4, "d.py", "def (:\n"), (5, "e.py", "import os\nx = 'os'\n"), (6, "f.py", "import os; y = 1\nimport re\n")]
    artifacts = artifacts_from_text(spark.createDataFrame(rows, "id long, path string, text string"), "id", "text", F.col("path"))
    plain = {r["artifact_id"]: r for r in transform(artifacts, Options(profile="code")).collect()}
    assert [(plain[k]["accepted"], plain[k]["all_passed"]) for k in range(1, 7)] == [(True, True), (False, False), (False, None), (False, False), (True, True), (True, True)]
    assert [plain[k]["rejected_reason"] for k in (2, 3, 4)] == [CHANGED, UNPROVEN, BROKEN]
    assert bytes(plain[5]["output"]) == b"import os\nx = 'os'\n" and bytes(plain[6]["output"]) == b"import os; y = 1\n"
    forced = {r["artifact_id"]: r for r in transform(artifacts, Options(profile="code", force_code=True)).collect()}
    assert [(forced[k]["accepted"], forced[k]["all_passed"]) for k in (2, 3, 4)] == [(True, False), (True, None), (False, False)]


def test_import_removal_rules():
    from siftglass.functions.pycode import removal_checks, without_unused_imports

    kept = ["from __future__ import annotations\n", "from x import *\n", "import os  # NOQA\n", "import a, b\nprint(b)\n", "def f():\n    import os\n", "import os\n__all__ = ['os']\n", "import os\ndef f():\n    global os\n", "def (\n"]
    for source in kept:
        assert without_unused_imports(source) == source
    assert without_unused_imports("import os  # gone\nfrom m import (\n    a,\n    b as c,\n)\nx = 1\n") == "x = 1\n"
    assert [p for _, p in removal_checks("import os\nx = 1\n", "x = 1\n")] == [True, True, True]
    assert [p for _, p in removal_checks("import os\nx = 1\n", "x = 2\n")] == [True, False, None]
    assert [p for _, p in removal_checks("import os\nos.x\n", "os.x\n")] == [True, True, False]
    assert [p for _, p in removal_checks("x = 1\n", "x = 1\ny = 2\n")] == [True, False, None]
    assert [p for _, p in removal_checks("from __future__ import annotations\n", "")] == [True, True, False]
    assert [p for _, p in removal_checks("x\n", "def (\n")] == [False, None, None]


def test_reports(spark, samples, tmp_path):
    from siftglass.operators.report import analyze, as_json, batch_summary, build_result, exit_code, nested, operations, read_reports, rendered
    from siftglass.operators.transform import Options

    reports = analyze(samples, Options(changes=False))
    assert reports.count() == len(SAMPLES)
    saved = f"file://{tmp_path}/saved"
    as_json(reports).select("report").write.text(saved)
    again = read_reports(spark, saved)
    shaped = nested(reports).drop("artifact_id")
    assert sorted(map(str, again.collect())) == sorted(map(str, shaped.collect()))
    bad = str(tmp_path / "bad")
    spark.createDataFrame([("{no report",)], "value string").write.text(bad)
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_reports(spark, bad).collect()
    one = json.loads(as_json(analyze(samples)).where(f"artifact_id = {SAMPLES.index(DIRTY)}").first()["report"])
    assert one["artifact"]["encoding"] == "utf-8-sig" and "transformation" not in one
    assert [i["name"] for i in one["inspection"]["inspectors"]] == ["unicode", "text_markers", "file_metadata", "office_metadata", "pdf_metadata", "c2pa"]
    inspected = analyze(samples)
    summary = batch_summary(inspected).first()
    assert summary["artifacts"] == len(SAMPLES) and summary["with_findings"] + summary["hidden"] == len(SAMPLES)
    assert exit_code(inspected) == 0 and exit_code(inspected, "warning") == 1 and exit_code(inspected, "bad") == 2 and exit_code(reports) == 1
    assert exit_code(inspected.where("size(findings) = 0"), "info") == 0
    block = rendered(inspected).where(f"artifact_id = {SAMPLES.index(DIRTY)}").first()["block"]
    assert "zero_width: 1 zero width character(s) present" in block and "unknown signal: " in block
    result = build_result(spark, "x.md", "a​b".encode(), "transform")
    assert __import__("base64").b64decode(result["output_base64"]) == b"ab\n"
    assert "output_base64" not in build_result(spark, "x.md", b"ab\n", "transform")
    assert operations(spark).count() == 14


def test_registry(spark):
    from siftglass.operators import registry

    rows = registry.matrix(spark).collect()
    assert len(rows) == 16
    assert all(r["source"] for r in rows if r["label"] == "confirmed" and r["provider"] != "generic")
    assert [r[0] for r in registry.providers(spark).collect()] == ["anthropic", "generic", "openai"]
    assert [registry.undetectable_signals(spark, k).count() for k in ("text", "source_code", "binary")] == [3, 2, 1]
    assert registry.capabilities(spark, "OpenAI", "binary").count() == 2


def test_tree_source_and_sinks(spark, tmp_path):
    from siftglass.sources.tree import UnsafeWrite, read_tree, safe_write, write_back

    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x").write_text("skipped")
    (tmp_path / ".hidden").write_text("seen")
    (tmp_path / "_sub").mkdir()
    (tmp_path / "_sub/b.txt").write_bytes(b"b" * 100)
    (tmp_path / "link").symlink_to(tmp_path / ".hidden")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in read_tree(spark, [str(tmp_path)], max_bytes=50).collect()}
    assert set(got) == {".hidden", "b.txt"}
    assert bytes(got[".hidden"]["data"]) == b"seen" and "above the 50 byte limit" in got["b.txt"]["error"]
    with pytest.raises(FileNotFoundError):
        read_tree(spark, [str(tmp_path / "none")])
    with pytest.raises(UnsafeWrite):
        safe_write(str(tmp_path / "link"), b"x")
    with pytest.raises(UnsafeWrite):
        safe_write(str(tmp_path / "none/x"), b"x")
    path = str(tmp_path / ".hidden")
    rows = [(path, bytearray(b"seen"), bytearray(b"new"), True), (str(tmp_path / "link"), bytearray(b"a"), bytearray(b"b"), True), (path, bytearray(b"q"), bytearray(b"q"), True), (path, bytearray(b"q"), bytearray(b"r"), False)]
    errors = write_back(spark.createDataFrame(rows, "path string, data binary, output binary, accepted boolean"), backup=True).collect()
    assert [r["path"] for r in errors] == [str(tmp_path / "link")]
    assert (tmp_path / ".hidden").read_bytes() == b"new" and (tmp_path / ".hidden.bak").read_bytes() == b"seen"
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".draft")]


def test_streams(spark, tmp_path):
    from siftglass.streaming.drop_folder import documents_stream, findings_over_time, findings_stream

    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "a​b", "en", "s", 3), (2, "plain", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(folder)
    query = findings_stream(documents_stream(spark, folder)).writeStream.format("memory").queryName("found").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["artifact_id"], r["category"]) for r in spark.table("found").collect()] == [(1, "zero_width")]
    timed = str(tmp_path / "timed")
    spark.sql("SELECT id AS doc_id, 'a​b' AS text, timestamp_seconds(id * 60) AS ts FROM range(30)").write.parquet(timed)
    stream = spark.readStream.schema("doc_id long, text string, ts timestamp").parquet(timed)
    query = findings_over_time(stream, "ts").writeStream.format("memory").queryName("counts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert {r["n"] for r in spark.table("counts").collect()} == {5}


def test_matching_blocks_are_those_of_the_standard_library():
    import random

    from siftglass.functions.sequences import compare, ratio

    rng = random.Random(8)
    for k in range(600):
        letters = "ab" if k % 2 else "abcdefgh "
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        b = "".join(c for c in a if rng.random() > 0.2) if k % 3 else "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        matcher = difflib.SequenceMatcher(a=a, b=b, autojunk=False)
        edits = sum(max(j - i, m - n) for tag, i, j, n, m in matcher.get_opcodes() if tag != "equal")
        assert compare(a, b) == (sum(x.size for x in matcher.get_matching_blocks()), edits), (a, b)
        assert ratio(a.split(), b.split()) == pytest.approx(difflib.SequenceMatcher(a=a.split(), b=b.split(), autojunk=False).ratio())


def test_coarse_classes_hold_all_letters():
    import sys

    ranges = lambda c: [(int(a, 16), int(b or a, 16)) for a, b in re.findall(r"\\x\{([0-9A-F]+)\}(?:-\\x\{([0-9A-F]+)\})?", c)]
    inside = lambda p, rs: any(a <= p <= b for a, b in rs)
    maybe_latin, maybe_other = ranges(C.MAYBE_LATIN), ranges(C.MAYBE_OTHER)
    for p in range(0x80, sys.maxunicode + 1):
        if chr(p).isalpha():
            named = unicodedata.name(chr(p), "").split(" ")[0] == "LATIN"
            assert inside(p, maybe_latin if named else maybe_other), hex(p)


def test_rows_that_share_an_id_are_artifacts_of_their_own(spark):
    from siftglass.operators.artifacts import artifacts_from_text
    from siftglass.operators.report import analyze
    from siftglass.operators.transform import Options

    rows = [(1, "a\u200bb\n"), (1, "clean\n"), (1, "a\u200bb\n"), (None, "x\u200b\n"), (None, "y\n")]
    artifacts = artifacts_from_text(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    for options in (None, Options()):
        got = analyze(artifacts, options).collect()
        assert sorted(len(r["findings"]) for r in got) == [0, 0, 1, 1, 1]
