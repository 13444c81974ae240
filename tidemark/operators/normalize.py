"""Normalising raw status dumps into metric samples.

Every dump is one row (``entity, tbl, ts, text``); parsing is row-local
array work (``split`` / ``regexp_extract`` / ``filter`` / ``posexplode``) and
then ``explode``, so it runs in the scan stage with no shuffle.  Whitelists
and renames are broadcast joins with an alias table (configuration).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_SPLIT = r"\r?\n"
KEYS = ["entity", "tbl", "ts"]


def lines(text: str = "text") -> Column:
    return F.split(F.col(text), LINE_SPLIT)


def parse_stat(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``STAT key value`` dumps; ``END`` and blank lines ignored.  A dump
    without an ``END`` line did not terminate properly and is discarded."""
    d = df.select(*keys, lines().alias("l")).where(F.array_contains("l", "END"))
    e = d.select(*keys, F.explode("l").alias("line"))
    # a line that matches has two blanks, and at most a line end after the value: it is cut without another match
    body = F.substr("line", F.lit(len("STAT ") + 1))
    return (e.where(F.col("line").rlike(r"^STAT (\S+) (\S+)$"))
            .select(*keys, F.substring_index(body, " ", 1).alias("key"),
                    F.rtrim(F.substring_index(body, " ", -1), F.lit("\r\n")).alias("raw")))


def parse_colon(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``key:value`` dumps; lines without ``:`` skipped; only the text up to
    a second ``:`` is the value; ``calls=N,usec=...`` values become N."""
    e = df.select(*keys, F.explode(lines()).alias("line"))
    parts = F.split(F.col("line"), ":")
    e = e.where(F.size(parts) > 1).select(*keys, parts.getItem(0).alias("key"), parts.getItem(1).alias("v"))
    calls = F.split(F.split(F.col("v"), ",").getItem(0), "=")
    raw = F.when(F.col("v").contains(","), F.try_element_at(calls, F.lit(2))).otherwise(F.col("v"))
    return e.select(*keys, "key", raw.alias("raw"))


def parse_eq(df: DataFrame, sentinel: str = "***", keys: Sequence[str] = KEYS) -> DataFrame:
    """``key = value`` dumps read until the first sentinel header line."""
    arr = lines()
    stop = F.array_position(F.transform(arr, lambda x: x.startswith(sentinel)), True)
    kept = F.when(stop > 0, F.slice(arr, 1, stop - 1)).otherwise(arr)
    e = df.select(*keys, F.explode(kept).alias("line"))
    parts = F.split(F.col("line"), "=")
    return (e.where(F.size(parts) == 2)
            .select(*keys, F.trim(parts.getItem(0)).alias("key"), F.trim(parts.getItem(1)).alias("raw")))


def parse_positional(df: DataFrame, names: Sequence[str], header_first: str = "S0",
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """Whitespace-separated rows; column i is metric ``names[i]``.  The header
    row (first field ``header_first``) and rows of the wrong arity are skipped."""
    # a line is split once: in a column, the filter would split it again
    rows = F.filter(F.transform(lines(), lambda x: F.split(F.trim(x), r"\s+")), lambda a: (F.size(a) == len(names)) & (a.getItem(0) != header_first))
    e = df.select(*keys, F.explode(rows).alias("a"))
    names_arr = F.array(*[F.lit(n) for n in names])
    z = e.select(*keys, F.posexplode("a").alias("pos", "raw"))
    return z.select(*keys, F.element_at(names_arr, F.col("pos") + 1).alias("key"), "raw")


def parse_prefix(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``PREFIX p k1 v1 k2 v2 ...`` dumps -> (prefix, key, raw); of a key that a line has
    several times, the last value."""
    e = df.select(*keys, F.explode(lines()).alias("line")).where(F.col("line") != "END")
    a = F.split(F.col("line"), r"\s+")
    e = e.select(*keys, a.alias("a")).where(F.size("a") >= 2)
    body = F.slice(F.col("a"), 3, F.greatest(F.size("a") - 2, F.lit(0)))
    e = e.select(*keys, F.col("a").getItem(1).alias("prefix"), F.filter(body, lambda x, i: i % 2 == 0).alias("ks"),
                 F.filter(body, lambda x, i: i % 2 == 1).alias("vs"))
    n = F.least(F.size("ks"), F.size("vs"))
    pairs = F.arrays_zip(F.slice("ks", 1, n).alias("key"), F.slice("vs", 1, n).alias("raw"))
    back = F.reverse(F.slice("ks", 1, n))
    last = F.filter(pairs, lambda p, i: F.array_position(back, p["key"]) == n - i)
    return e.select(*keys, "prefix", F.inline(last))


def unit_number(raw: Column) -> Column:
    """Numbers with an optional ``K`` / ``M`` / ``G`` suffix -> double."""
    last = F.substring(raw, -1, 1)
    body = F.when(last.isin("K", "M", "G"), F.substr(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw)
    mult = F.when(last == "G", 1e9).when(last == "M", 1e6).when(last == "K", 1e3).otherwise(1.0)
    return body.try_cast("double") * mult


def apply_alias(parsed: DataFrame, alias: DataFrame, keys: Sequence[str] = KEYS,
                plugin: str | None = None) -> DataFrame:
    """Whitelist + rename + unit factor + integer truncation.

    ``alias``: ``(plugin, raw_key, metric, factor)`` (tiny, broadcast).  Keys
    not in the alias table are dropped.  ``int()`` semantics: the scaled
    value is truncated toward zero (``cast`` to bigint).
    """
    a = alias if plugin is None else alias.where(F.col("plugin") == plugin)
    j = parsed.join(F.broadcast(a.select(F.col("raw_key").alias("key"), "metric", "factor")), "key")
    v = unit_number(F.col("raw")) * F.col("factor")
    return j.select(*keys, "metric", v.try_cast("bigint").alias("value"))


def fill_missing(values: DataFrame, alias: DataFrame, dumps: DataFrame, keys: Sequence[str] = KEYS,
                 plugin: str | None = None, default: int = 0) -> DataFrame:
    """Every whitelisted metric present in every dump: absent ones get
    ``default``.  The product dumps x metrics is bounded by the (small)
    metric list per plugin; done with ``explode`` of that list, not a join."""
    a = alias if plugin is None else alias.where(F.col("plugin") == plugin)
    metrics = sorted({r[0] for r in a.select("metric").distinct().collect()})
    grid = dumps.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    return (grid.join(values, [*keys, "metric"], "left")
            .select(*keys, "metric", F.coalesce(F.col("value"), F.lit(default).cast("bigint")).alias("value")))
