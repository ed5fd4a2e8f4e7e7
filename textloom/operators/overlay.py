"""Overlays of file trees and selection by alias."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlay(base: DataFrame, translated: DataFrame, locked: DataFrame, key: str, value: str) -> DataFrame:
    """The base tree under the translated files that aren't locked; a translated file wins, also if the base lacks it."""
    upper = translated.join(locked.select(key), key, "left_anti").select(key, F.col(value).alias("__over"), F.lit(True).alias("__there"))
    joined = base.select(key, value).join(upper, key, "full_outer")
    return joined.select(key, F.coalesce("__over", value).alias(value), F.col("__there").isNotNull().alias("overlaid"))


def select_targets(requests: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (ord, name) against targets (target_ord, target, aliases): the chosen, each once in order of request, and the missing."""
    wanted = requests.select("ord", "name", F.lower("name").alias("alias"))
    known = targets.select("target_ord", "target", F.explode(F.transform("aliases", lambda a: F.lower(a))).alias("alias")).groupBy("alias").agg(F.min_by(F.struct("target_ord", "target"), "target_ord").alias("t"))
    met = wanted.join(known, "alias", "left")
    missing = met.filter("t is null").select("ord", "name")
    turn = F.row_number().over(Window.partitionBy("target").orderBy("ord"))
    chosen = met.filter("t is not null").select("ord", "name", "t.target").withColumn("turn", turn).filter("turn = 1").drop("turn")
    return chosen, missing
