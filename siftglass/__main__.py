"""Command line: ``python -m siftglass inspect|transform|validate|capabilities|operations|report ...``.

Exit codes: 0 for nothing to report, 1 for findings at the wanted severity or a refused output, 2 for errors.
"""

from __future__ import annotations

import argparse
import json

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftglass.functions.cleaning import PROFILES, resolve_operations
from siftglass.operators import registry
from siftglass.operators import report as R
from siftglass.operators.artifacts import artifacts_from_binary
from siftglass.operators.checks import MIN_SIMILARITY, validate_pairs
from siftglass.operators.transform import Options
from siftglass.sources.tree import UnsafeWrite, read_tree, safe_write, write_back

KINDS = ("text", "source_code", "binary")


def _session() -> SparkSession:
    return SparkSession.builder.appName("siftglass").config("spark.ui.enabled", "false").getOrCreate()


def _loaded(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[dict[str, str]]]:
    """Artifacts of the files below some paths, and what couldn't be read."""
    files = read_tree(spark, paths)
    errors = [{"path": r["path"], "error": r["error"]} for r in files.where("error IS NOT NULL").select("path", "error").collect()]
    numbered = files.where("error IS NULL").select(F.xxhash64("path").alias("id"), "path", "data")
    return artifacts_from_binary(numbered, "id", "data", "path"), errors


def _show(reports: DataFrame, errors: list[dict[str, str]], as_json: bool, verbose: bool) -> None:
    if as_json:
        lines = [json.loads(r["report"]) for r in R.as_json(reports).toLocalIterator()]
        single = len(lines) == 1 and not errors
        whole = lines[0] if single else {"schema_version": R.SCHEMA_VERSION, "tool_version": R.TOOL_VERSION, "reports": lines, "errors": errors}
        print(json.dumps(whole, indent=2, ensure_ascii=False))
        return
    total = R.batch_summary(reports).first()
    assert total is not None
    single = total["artifacts"] == 1 and not errors
    shown = reports if single or verbose else reports.where("size(findings) > 0" + (" OR performed" if "performed" in reports.columns else ""))
    for row in R.rendered(shown).toLocalIterator():
        print(row["block"] + "\n")
    for e in errors:
        print(f"error      {e['path']}: {e['error']}\n")
    print(f"summary    {total['artifacts']} artifact(s), {total['with_findings']} with findings, {len(errors)} error(s)")
    if not single and not verbose and total["hidden"]:
        print(f"           {total['hidden']} clean artifact(s) not shown; use --verbose")
    print("\n" + R.DISCLAIMER)


def _inspect(a: argparse.Namespace) -> int:
    artifacts, errors = _loaded(_session(), a.paths)
    reports = R.analyze(artifacts)
    _show(reports, errors, a.json, a.verbose)
    return R.exit_code(reports, a.fail_on, len(errors))


def _transform(a: argparse.Namespace) -> int:
    if a.output and a.in_place:
        raise ValueError("--output and --in-place are mutually exclusive")
    options = Options(a.profile, tuple(a.op) if a.op else None, a.min_similarity, a.force)
    resolve_operations(options.profile, a.op)
    artifacts, errors = _loaded(_session(), a.paths)
    single = artifacts.limit(2).count() + len(errors) == 1
    if a.output and not single:
        raise ValueError("--output requires exactly one input file")
    reports = R.analyze(artifacts, options)
    if a.in_place:
        outputs = reports.join(artifacts.select("artifact_id", "data"), "artifact_id")
        errors += [r.asDict() for r in write_back(outputs.select("path", "data", "output", "accepted"), a.backup).collect()]
    elif single and not errors:
        row = reports.first()
        assert row is not None
        if row["accepted"] and a.output:
            try:
                safe_write(a.output, bytes(row["output"]), a.backup)
            except UnsafeWrite as problem:
                errors.append({"path": a.output, "error": str(problem)})
        elif row["accepted"] and not a.json:
            sys.stdout.buffer.write(bytes(row["output"]))
            return R.EXIT_OK
    _show(reports, errors, a.json, a.verbose)
    return R.exit_code(reports, "never", len(errors))


def _validate(a: argparse.Namespace) -> int:
    spark = _session()
    sides = [artifacts_from_binary(read_tree(spark, [p]).select(F.lit(0).alias("id"), "data"), "id", "data").first() for p in (a.before, a.after)]
    if any(s is None or s["text"] is None for s in sides):
        raise ValueError("both inputs must be decodable UTF-8 text")
    pair = spark.createDataFrame([(0, sides[0]["text"], sides[1]["text"])], "id int, before string, after string")  # type: ignore[index]
    row = validate_pairs(pair, "id", "before", "after", a.min_similarity).first()
    assert row is not None
    if a.json:
        print(json.dumps({"performed": True, "all_passed": row["all_passed"], "checks": [c.asDict() for c in row["checks"]]}, indent=2))
    else:
        print(f"validation all_passed={row['all_passed']}")
        for c in row["checks"]:
            print(f"   [{ {True: 'pass', False: 'FAIL', None: 'n/a '}[c['passed']] }] {c['name']}: {c['measurements']}")
    return R.EXIT_FINDINGS if row["all_passed"] is False else R.EXIT_OK


def _capabilities(a: argparse.Namespace) -> int:
    for r in registry.capabilities(_session(), a.provider, a.kind).drop("ordinal").orderBy("provider", "artifact_kind", "surface").collect():
        print(json.dumps(r.asDict()) if a.json else f"{r['provider']}/{r['surface']} {r['artifact_kind']} {r['signal']}: {r['detectability']} ({r['label']})")
    return R.EXIT_OK


def _operations(a: argparse.Namespace) -> int:
    for r in R.operations(_session()).collect():
        print(json.dumps(r.asDict()) if a.json else f"{r['operation']}: {r['description']} [{', '.join(r['profiles'])}]")
    return R.EXIT_OK


def _report(a: argparse.Namespace) -> int:
    """A saved report or batch, read with the schema that reports are saved in."""
    with open(a.path, encoding="utf-8") as f:
        saved = json.load(f)
    reports = saved["reports"] if "reports" in saved else [saved]
    for r in reports:
        reference, found = r["artifact"], r["inspection"]["findings"]
        print(f"artifact   {reference.get('path') or '<stdin>'}\n           kind={reference['kind']}\n           sha256={reference['sha256']}  size={reference['size_bytes']}B")
        print(f"findings ({len(found)})" if found else "findings   none")
        for f in found:
            print(f"{R.MARKS[f['severity']]} [{f['evidence_class']}] {f['category']}: {f['summary']}")
    return R.EXIT_OK


def parser() -> argparse.ArgumentParser:
    """The commands and their options."""
    out = argparse.ArgumentParser(prog="siftglass")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, run: object) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("--json", action="store_true")
        return c

    c = command("inspect", _inspect)
    c.add_argument("paths", nargs="+")
    c.add_argument("--fail-on", default="never")
    c.add_argument("--verbose", "-v", action="store_true")
    c = command("transform", _transform)
    c.add_argument("paths", nargs="+")
    c.add_argument("--profile", default="standard", choices=sorted(PROFILES))
    c.add_argument("--op", action="append")
    c.add_argument("--in-place", action="store_true")
    c.add_argument("--output", "-o")
    c.add_argument("--backup", action="store_true")
    c.add_argument("--force", action="store_true")
    c.add_argument("--min-similarity", type=float, default=MIN_SIMILARITY)
    c.add_argument("--verbose", "-v", action="store_true")
    c = command("validate", _validate)
    c.add_argument("before")
    c.add_argument("after")
    c.add_argument("--min-similarity", type=float, default=MIN_SIMILARITY)
    c = command("capabilities", _capabilities)
    c.add_argument("--provider")
    c.add_argument("--kind", choices=KINDS)
    command("operations", _operations)
    command("report", _report).add_argument("path")
    return out


def main(arguments: list[str] | None = None) -> int:
    """Run one command."""
    chosen = parser().parse_args(arguments)
    try:
        return int(chosen.run(chosen))
    except (FileNotFoundError, ValueError, KeyError, OSError) as problem:
        print(f"error: {problem.args[0] if problem.args else problem}", file=sys.stderr)
        return R.EXIT_ERROR


if __name__ == "__main__":
    code = main()
    sys.stdout.flush()
    sys.exit(code)
