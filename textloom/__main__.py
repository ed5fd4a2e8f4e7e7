"""Commands over folders: extract, sync, precheck, inject, check, overlay.

    python -m textloom extract --source scripts --output entries
    python -m textloom sync --source scripts --old entries --output synced
    python -m textloom precheck --entries entries --output clean [--mode fast]
    python -m textloom inject --source scripts --entries clean --output translated [--copy-source] [--errors archive]
    python -m textloom check --source scripts --translated translated [--strict] [--errors archive]
    python -m textloom overlay --source scripts --translated translated --output build
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import inject, match, scripts
from .operators.overlay import overlay
from .session import session
from .sources import files


def counted(df: DataFrame) -> dict:
    return {r["status"]: r["n"] for r in df.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}


def extract(spark: SparkSession, a: argparse.Namespace) -> dict:
    found = scripts.extract_entries(files.scripts(spark, a.source))
    files.write_entries(found, a.output)
    return {"entries": found.count()}


def sync(spark: SparkSession, a: argparse.Namespace) -> dict:
    old = files.old_entries(spark, a.old).select(*files.ENTRY_COLUMNS)
    merged = match.sync(scripts.extract_entries(files.scripts(spark, a.source)), old).persist()
    return files.write_sync(merged, a.output)["stats"]


def precheck(spark: SparkSession, a: argparse.Namespace) -> dict:
    found, broken = files.entries(spark, a.entries)
    clean, reports = scripts.precheck(found, symbols=a.mode != "fast")
    files.write_entries(clean, a.output)
    return {"entries": found.count(), "kept": clean.count(), "reported": reports.count(), "broken_files": broken.count()}


def inject_all(spark: SparkSession, a: argparse.Namespace) -> dict:
    source = files.scripts(spark, a.source)
    done = inject.inject(source, files.entries(spark, a.entries)[0]).filter("not missing_source").persist()
    changed = done.join(source.select("path", F.col("text").alias("before")), "path").filter(~F.col("text").eqNullSafe(F.col("before")))
    _, locked = scripts.checked(source, changed.select("path", "text"))
    final = inject.survivors(source, done, locked).persist()
    if a.errors:
        told = inject.issues_of(done).withColumn("message", F.concat_ws(": ", "key", "message")).withColumn("line", F.lit(None).cast("int"))
        files.write_issues(told, a.errors, "inject")
    files.write_texts(overlay(source, final, locked.limit(0), "path", "text") if a.copy_source else final, a.output)
    total = done.agg(F.sum("applied").alias("applied"), F.sum("skipped").alias("skipped"), F.count_if("rolled_back").alias("rolled_back")).first()
    return {**total.asDict(), "files": final.count(), "locked": final.filter("locked").count()}


def check(spark: SparkSession, a: argparse.Namespace) -> dict:
    source, translated = files.scripts(spark, a.source), files.scripts(spark, a.translated)
    issues, locked = scripts.checked(source, translated, files.lint_config(a.source))
    if a.errors:
        files.write_issues(issues, a.errors, "check")
    codes = {r["code"]: r["n"] for r in issues.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code").collect()}
    guard = scripts.guard_drift(source, translated).select("path").distinct().count() if a.strict else 0
    return {"files": translated.count(), "locked": locked.count(), "drifted": guard, "issues": codes}


def overlay_all(spark: SparkSession, a: argparse.Namespace) -> dict:
    source, translated = files.scripts(spark, a.source), files.scripts(spark, a.translated)
    _, locked = scripts.checked(source, translated)
    built = overlay(source, translated, locked, "path", "text")
    files.write_texts(built, a.output)
    return {"files": built.count(), "overlaid": built.filter("overlaid").count()}


COMMANDS = {
    "extract": (extract, ("source", "output")),
    "sync": (sync, ("source", "old", "output")),
    "precheck": (precheck, ("entries", "output")),
    "inject": (inject_all, ("source", "entries", "output")),
    "check": (check, ("source", "translated")),
    "overlay": (overlay_all, ("source", "translated", "output")),
}


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="textloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, needed) in COMMANDS.items():
        own = commands.add_parser(name)
        for option in needed:
            own.add_argument(f"--{option}", required=True)
        own.add_argument("--concurrency", default="*")
    commands.choices["precheck"].add_argument("--mode", choices=("fast", "balanced", "strict"), default="balanced")
    commands.choices["inject"].add_argument("--copy-source", action="store_true")
    for name in ("inject", "check"):
        commands.choices[name].add_argument("--errors", help="folder for an archive of issues")
    commands.choices["check"].add_argument("--strict", action="store_true")
    a = parser.parse_args(arguments)
    result = COMMANDS[a.command][0](session(cores=a.concurrency), a)
    print(json.dumps(result, ensure_ascii=False))
    return int(a.command == "check" and (result["locked"] > 0 or result["drifted"] > 0))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
