"""The command line, end to end, within the tests' session."""

import json

import pytest

from siftglass.__main__ import main


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "clean.md").write_text("# Fine\n\ntext\n")
    (tmp_path / "dirty.md").write_text("a​b\n")
    (tmp_path / "code.kt").write_text("val x = 1  \n")
    return tmp_path


def test_inspect(spark, tree, capsys):
    assert main(["inspect", str(tree)]) == 0
    shown = capsys.readouterr().out
    assert "3 artifact(s), 1 with findings, 0 error(s)" in shown and "2 clean artifact(s) not shown" in shown
    assert main(["inspect", str(tree), "--fail-on", "warning", "--json"]) == 1
    assert len(json.loads(capsys.readouterr().out)["reports"]) == 3
    assert main(["inspect", str(tree / "clean.md"), "--fail-on", "info", "--json"]) == 0
    one = json.loads(capsys.readouterr().out)
    assert one["artifact"]["kind"] == "text" and one["inspection"]["findings"] == []
    assert main(["inspect", str(tree / "none")]) == 2
    assert main(["inspect", str(tree), "--fail-on", "bad"]) == 2


def test_transform(spark, tree, capsysbinary):
    assert main(["transform", str(tree / "dirty.md")]) == 0
    assert capsysbinary.readouterr().out == b"ab\n"
    target = tree / "out.md"
    assert main(["transform", str(tree / "dirty.md"), "-o", str(target)]) == 0 and target.read_text() == "ab\n"
    assert main(["transform", str(tree), "-o", str(target)]) == 2
    assert main(["transform", str(tree / "dirty.md"), "-o", str(target), "--in-place"]) == 2
    assert main(["transform", str(tree / "dirty.md"), "--op", "nope"]) == 2
    target.unlink()
    assert main(["transform", str(tree), "--in-place", "--backup"]) == 1  # the Kotlin file is refused
    assert (tree / "dirty.md").read_text() == "ab\n" and (tree / "dirty.md.bak").exists()
    assert (tree / "code.kt").read_text() == "val x = 1  \n" and not (tree / "clean.md.bak").exists()


def test_validate_and_listings(spark, tree, capsys, tmp_path):
    (tree / "other.md").write_text("# Fine\n\nother\n")
    assert main(["validate", str(tree / "clean.md"), str(tree / "clean.md")]) == 0
    assert main(["validate", str(tree / "clean.md"), str(tree / "other.md"), "--json"]) == 1
    capsys.readouterr()
    assert main(["capabilities", "--kind", "binary"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 3
    assert main(["operations"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 14
    assert main(["inspect", str(tree / "dirty.md"), "--json"]) == 0
    (tmp_path / "saved.json").write_text(capsys.readouterr().out)
    assert main(["report", str(tmp_path / "saved.json")]) == 0
    assert "zero_width" in capsys.readouterr().out
    (tmp_path / "bad.json").write_text("{}")
    assert main(["report", str(tmp_path / "bad.json")]) == 2


def test_a_path_given_twice_is_reported_twice(spark, tree, capsys):
    path = str(tree / "dirty.md")
    assert main(["inspect", path, path, "--json"]) == 0
    reports = json.loads(capsys.readouterr().out)["reports"]
    assert len(reports) == 2 and all(len(r["inspection"]["findings"]) == 1 for r in reports)
    assert main(["transform", path, path, "--json"]) == 0
    assert len(json.loads(capsys.readouterr().out)["reports"]) == 2
