"""Alarm rule sets and glob rule matching.

Rule sets are configuration (tens of rows) and are broadcast.  Matching is
done on the *distinct keys* of the data, never on the samples: the theta
join (``rlike``) is a BroadcastNestedLoopJoin of distinct keys x rules,
linear in the number of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import glob_to_regex


@dataclass
class AbsRule:
    """``pattern`` over ``client:instance``; limits per metric per level
    (None or 0 = level off)."""
    pattern: str
    limits: dict[str, tuple]
    ignore: str | None = None


@dataclass
class LambdaRule:
    """Predicate rule on raw current values: ``fn(m, limit) -> (Column bool,
    Column message)`` with ``m['metric']`` a Column."""
    pattern: str
    name: str
    fn: Callable
    limits: tuple
    ignore: str | None = None


def _limit_text(v) -> str:
    return repr(v)


def abs_rules_frame(spark: SparkSession, rules: Sequence[AbsRule]) -> DataFrame:
    """``rule_ord, pattern, regex, ignore_regex, metric, level, limit, limit_text``.

    A metric has as many levels as limits are given; levels that are off
    (None / 0) never fire.
    """
    rows = []
    for i, r in enumerate(rules):
        for metric, lims in r.limits.items():
            for lvl, lim in enumerate(lims):
                rows.append((i, r.pattern, glob_to_regex(r.pattern),
                             glob_to_regex(r.ignore) if r.ignore else None, metric, lvl,
                             None if lim is None else float(lim), _limit_text(lim)))
    return spark.createDataFrame(
        rows, "rule_ord int, pattern string, regex string, ignore_regex string, metric string, "
              "level int, limit double, limit_text string")


def rule_heads(rules: DataFrame) -> DataFrame:
    return rules.select("rule_ord", "pattern", "regex", "ignore_regex").distinct()


def match_first(keys: DataFrame, heads: DataFrame, key: str = "key") -> DataFrame:
    """First-match rule selection: an exact pattern equal to the key wins,
    else the first glob in declaration order whose IGNORE glob does not
    match.  ``keys`` must be distinct keys; returns ``(key, rule_ord)``."""
    k = F.col(key)
    cond = (k == F.col("pattern")) | (
        F.regexp_like(k, F.col("regex")) & ~F.coalesce(F.regexp_like(k, F.col("ignore_regex")), F.lit(False)))
    cand = keys.join(F.broadcast(heads), cond, "inner")
    rank = F.struct(F.when(k == F.col("pattern"), 0).otherwise(1).alias("x"), F.col("rule_ord").alias("o"))
    best = cand.groupBy(key).agg(F.min(rank).alias("__b"))
    return best.select(key, F.col("__b.o").alias("rule_ord"))


def overlay(keys: DataFrame, entries: DataFrame, key: str = "key") -> DataFrame:
    """Rule overlay: ``default`` first, then the exact entry for the key if
    any, else every matching glob in declaration order; later entries
    overwrite per metric.

    ``entries``: ``(entry_ord, pattern, regex, metric, level, limit)`` where
    pattern ``'default'`` is the base.  Returns ``(key, metric, level, limit)``.
    """
    k = F.col(key)
    heads = entries.select("entry_ord", "pattern", "regex").distinct()
    exact_keys = keys.join(F.broadcast(heads.where(F.col("pattern") != "default")),
                           k == F.col("pattern"), "left_semi")
    cand = keys.join(F.broadcast(heads), (F.col("pattern") == "default") | (k == F.col("pattern"))
                     | F.regexp_like(k, F.col("regex")), "inner")
    cand = cand.join(exact_keys.withColumn("__has_exact", F.lit(True)), key, "left")
    cand = cand.where((F.col("pattern") == "default") | (k == F.col("pattern")) | F.col("__has_exact").isNull())
    prio = F.when(F.col("pattern") == "default", F.lit(-1)).otherwise(F.col("entry_ord"))
    j = cand.select(key, "entry_ord", prio.alias("prio")).join(
        F.broadcast(entries.select("entry_ord", "metric", "level", "limit")), "entry_ord")
    best = j.groupBy(key, "metric", "level").agg(F.max_by("limit", "prio").alias("limit"))
    return best


def key_of(entity: str = "entity", tbl: str = "tbl") -> Column:
    """Alarm key ``client:instance`` (instance = table name after the plugin)."""
    from ..functions.patterns import instance_of
    return F.concat(F.col(entity), F.lit(":"), instance_of(tbl))
