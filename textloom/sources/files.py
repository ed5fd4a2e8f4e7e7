"""Readers and writers of scripts, entry files and reports.

Paths in the tables are relative to their root, with forward slashes. Reading is Spark's own; only small control
files (configuration, archives) are handled on the driver.
"""

from __future__ import annotations

import json
import os
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scripts import LintConfig

# Names of files.
SCRIPTS, ENTRY_FILES, REPORT, OBSOLETE, LINT_FILE = "*.qsrc", "*.json", "_sync_report.json", "obsolete", ".qsrclintrc"
ENTRY = "array<struct<key:string,original:string,translation:string,stage:int,context:string>>"
#: Root of translations is the first of these that holds entry files.
ENTRY_COLUMNS = ("path", "entry_idx", "key", "original", "translation", "stage", "context")


def relative(path: Column, root: str) -> Column:
    """A file's path below the root, whatever the scheme in front."""
    bare = F.regexp_replace(path, "^[a-z]+:/+", "/")
    inner = "/" + root.split("://")[-1].split(":")[-1].strip("/") + "/"
    return F.when(F.locate(inner, bare) > 0, F.substring_index(bare, inner, -1)).otherwise(F.regexp_replace(bare, "^/", ""))


def missing(spark: SparkSession, root: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path) and not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(root)
    return not fs.exists(path)


def whole_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, text, size) of all files below the root that fit the pattern; no root, no rows; line ends as LF."""
    if missing(spark, root):
        return spark.createDataFrame([], "path string, text string, size bigint")
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    text = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n")
    return raw.select(relative(path, root).alias("path"), text.alias("text"), F.col("_metadata.file_size").alias("size"))


def scripts(spark: SparkSession, root: str, pattern: str = SCRIPTS) -> DataFrame:
    return whole_files(spark, root, pattern)


def entries(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(entries, broken paths): files are arrays of entries; one that doesn't parse as a whole is broken and gives none.

    A path is the script's: the file's without ``.json``. Missing fields are empty, a missing stage 0, unknown fields are dropped.
    """
    files = whole_files(spark, root, ENTRY_FILES).withColumn("path", F.regexp_replace("path", "[.]json$", ""))
    parsed = files.select("path", F.from_json("text", ENTRY, {"mode": "PERMISSIVE"}).alias("list"))
    broken = parsed.filter("list is null or exists(list, e -> e is null)").select("path")
    rows = parsed.filter("list is not null and not exists(list, e -> e is null)").select("path", F.posexplode("list").alias("entry_idx", "e"))
    filled = [F.coalesce(F.col(f"e.{c}"), F.lit(0 if c == "stage" else "")).alias(c) for c in ENTRY_COLUMNS[2:]]
    return rows.select("path", "entry_idx", *filled), broken


def old_entries(spark: SparkSession, root: str) -> DataFrame:
    """A catalog of an earlier sync: without its report, archived entries under their live path."""
    found, _ = entries(spark, root)
    live = F.regexp_replace("path", f"^{OBSOLETE}/", "")
    return found.filter(~F.col("path").rlike(rf"(^|/){REPORT.removesuffix('.json')}$")).withColumn("archived", F.col("path").startswith(f"{OBSOLETE}/")).withColumn("path", live)


def write_entries(found: DataFrame, root: str) -> None:
    """One indented JSON array for each path, ``.json`` added, in order of entry_idx, written where the rows are.

    For shared file systems that executors can open; elsewhere, write the table itself.
    """

    def dump(frame: pd.DataFrame) -> pd.DataFrame:
        path = frame["path"].iloc[0]
        rows = frame.sort_values("entry_idx", kind="stable")
        out = [{c: (int(r[c]) if c == "stage" else r[c]) for c in ENTRY_COLUMNS[2:]} for r in rows.to_dict("records")]
        put(root, f"{path}.json", json.dumps(out, ensure_ascii=False, indent=2))
        return pd.DataFrame({"path": [path], "n": [len(out)]})

    found.select(*ENTRY_COLUMNS).groupBy("path").applyInPandas(dump, "path string, n int").write.format("noop").mode("overwrite").save()


def write_texts(files: DataFrame, root: str) -> None:
    """Each text under its path, line ends as they are."""

    def dump(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, text in zip(frame["path"], frame["text"], strict=True):
                put(root, path, text)
            yield frame[["path"]]

    files.select("path", "text").mapInPandas(dump, "path string").write.format("noop").mode("overwrite").save()


def put(root: str, path: str, text: str) -> None:
    target = Path(root, path).resolve()
    if not target.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{path} leaves {root}")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8", newline="")


def write_sync(merged: DataFrame, root: str) -> dict:
    """The outcome of a sync: live entries, archived ones under ``obsolete/``, and the report, which it returns."""
    write_entries(merged.filter("status <> 'removed'"), root)
    write_entries(merged.filter("status = 'removed'").withColumn("path", F.concat(F.lit(f"{OBSOLETE}/"), "path")), root)
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    rows = [r.asDict() for r in merged.groupBy("path").agg(count("migrated"), count("new"), count("removed")).orderBy("path").collect()]  # a row for each file
    live = [r for r in rows if r["migrated"] + r["new"]]
    total = {k: sum(r[k] for r in rows) for k in ("migrated", "new", "removed")}
    report = {
        "output_root": root,
        "obsolete_root": f"{root}/{OBSOLETE}",
        "stats": {"files_total": len(live), "files_written": len(live), "extracted_entries": total["migrated"] + total["new"], **{f"{k}_entries": v for k, v in total.items()}},
        "files": [{"file": r["path"], **{k: r[k] for k in total}} for r in live],
        "removed_files": [r["path"] for r in rows if r not in live],
        "obsolete_files": [f"{OBSOLETE}/{r['path']}" for r in rows if r["removed"]],
    }
    put(root, REPORT, json.dumps(report, ensure_ascii=False, indent=2))
    return report


def issue_lines(issues: DataFrame) -> DataFrame:
    """(path, report): the text of an error archive for each path; details that look like a diff stand as they are."""
    place = F.coalesce(F.concat(F.lit(" line "), F.col("line").cast("string")), F.lit(""))
    head = F.concat(F.lit("# "), "severity", F.lit(" "), "code", place)
    body = F.when(F.col("message").rlike(r"^(---|\+\+\+|@@|[-+ ])"), F.col("message")).otherwise(F.concat(F.lit("#   "), "message"))
    rows = issues.select("path", "line", "code", F.concat_ws("\n", head, body).alias("block"))
    return rows.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line", "code", "block"))).getField("block"), "\n").alias("report"))


def archive_path(path: Column, category: str) -> Column:
    """Where the issues of a path lie in an archive; paths outside the root by their name alone, unknown ones together."""
    outside = path.rlike(r"^([A-Za-z]:)?[/\\]|(^|/)\.\.(/|$)")
    inner = F.when(F.coalesce(F.trim(path), F.lit("")) == "", "_misc/unknown").when(outside, F.concat(F.lit("_external/"), F.regexp_extract(path, r"([^/\\]*)$", 1))).otherwise(path)
    return F.concat(F.lit(f"{category}/"), inner, F.lit(".diff"))


def write_issues(issues: DataFrame, root: str, category: str) -> None:
    """An archive file for each path below the category, in place of one of an earlier run; issues without a line come first."""
    placed = issues.withColumn("path", archive_path(F.col("path"), category))
    write_texts(issue_lines(placed).withColumnRenamed("report", "text"), root)


def lint_config(start: str) -> LintConfig:
    """The nearest configuration file at or above a folder; none or a broken one gives the defaults."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (found := folder / LINT_FILE).exists():
            try:
                return LintConfig.of(json.loads(found.read_text(encoding="utf-8")))
            except ValueError:
                return LintConfig()
    return LintConfig()


def detect_root(base: str, marker: str) -> str | None:
    """The folder itself or its first subfolder, by name, that holds a file that fits the marker."""
    top = Path(base)
    folders = [top, *sorted(p for p in top.iterdir() if p.is_dir())] if top.is_dir() else []
    return next((str(f) for f in folders if next(f.rglob(marker), None)), None)


def extract_archive(archive: str, target: str) -> list[str]:
    """Unpacks a zip file; nothing is written if any member would leave the target."""
    root = Path(target).resolve()
    with zipfile.ZipFile(archive) as packed:
        names = packed.namelist()
        for name in names:
            if not (root / name).resolve().is_relative_to(root):
                raise ValueError(f"{name} leaves {target}")
        root.mkdir(parents=True, exist_ok=True)
        packed.extractall(root)
    return names


def reset_folder(folder: str, workspace: str) -> None:
    """Empties a result folder, which must lie inside the workspace."""
    target, root = Path(folder).resolve(), Path(workspace).resolve()
    if target == root or not target.is_relative_to(root):
        raise ValueError(f"{folder} is not inside {workspace}")
    for base, folders, names in os.walk(target, topdown=False):
        for name in names:
            os.remove(os.path.join(base, name))
        for name in folders:
            os.rmdir(os.path.join(base, name))
    target.mkdir(parents=True, exist_ok=True)
