"""A store of rollup tiers: one folder a (tier, day), late samples repaired, old rows dropped.

Raw samples lie as :func:`store.append_samples` writes them, a folder a day.  A
tier's folder is always written whole from the samples of its days, so writing
it again (a rerun, a retry, late samples) gives the same rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecols import add_seconds, bucket_start, to_ntz_literal
from ..operators.aggregate import DEFAULT_XFF, chained_tiers

DAY_S = 86_400


def write_tiers(samples: DataFrame, path: str, keys: Sequence[str], base_step_s: int, steps: Sequence[int], xff: float = DEFAULT_XFF,
                folders: DataFrame | None = None) -> None:
    """All tiers of ``samples`` (or those in ``folders``: step_s, day); folders that get no row stay."""
    tiers = chained_tiers(samples, keys, base_step_s, steps, xff).withColumn("day", F.to_date("ts"))
    if folders is not None:
        tiers = tiers.join(folders, ["step_s", "day"], "left_semi")
    tiers.repartition("step_s", "day", F.pmod(F.xxhash64(*keys), F.lit(8))).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("step_s", "day").parquet(path)


def repair_tiers(raw: DataFrame, late: DataFrame, path: str, keys: Sequence[str], base_step_s: int, steps: Sequence[int],
                 xff: float = DEFAULT_XFF) -> list[dt.date]:
    """Write again the folders that ``late`` samples touch, from ``raw`` (all samples, the late ones
    too, with their ``day``); returns the days of raw samples that were read for it.

    Only days come to the driver, one number a day that late samples touch, so that they prune the
    folders of ``raw`` as literals.  A day of raw samples that is in no touched folder is not read.
    """
    buckets = F.array(*[F.struct(F.lit(s).cast("int").alias("step_s"), F.to_date(bucket_start("ts", s)).alias("day")) for s in steps])
    folders = late.select(F.inline(buckets)).distinct()
    # a bucket that starts in a folder's day ends up to its width later
    reach = F.date_add("day", F.ceil((F.col("step_s") - 1) / F.lit(DAY_S)).cast("int"))
    days = [r.day for r in folders.select(F.explode(F.sequence("day", reach)).alias("day")).distinct().orderBy("day").collect()]
    if days:
        write_tiers(raw.where(F.col("day").isin(days)), path, keys, base_step_s, steps, xff, folders)
    return days


def read_tiers(spark: SparkSession, path: str, keep: Mapping[int, int] | None = None, now=None) -> DataFrame:
    """Rows of the store; with ``keep`` (rows kept of each tier, by its width) only those that are kept at ``now``."""
    rows = spark.read.parquet(path)
    if keep is None:
        return rows
    kept = F.lit(False)
    for step, n in keep.items():
        kept = kept | ((F.col("step_s") == step) & (F.col("ts") > add_seconds(to_ntz_literal(now), -step * n)))
    return rows.where(kept)


def expire_tiers(spark: SparkSession, path: str, keep: Mapping[int, int], now: dt.datetime) -> list[str]:
    """Drop the folders all of whose rows are older than ``keep`` allows at ``now``; returns their
    names.  The rest of the limit, within a folder's day, is :func:`read_tiers`'."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for step, n in keep.items():
        tier = jvm.org.apache.hadoop.fs.Path(root, f"step_s={step}")
        if not fs.exists(tier):
            continue
        oldest = now - dt.timedelta(seconds=step * n)
        for found in fs.listStatus(tier):
            name = found.getPath().getName()
            if name.startswith("day=") and dt.datetime.fromisoformat(name[4:]) + dt.timedelta(days=1) <= oldest:
                fs.delete(found.getPath(), True)
                gone.append(f"step_s={step}/{name}")
    return sorted(gone)
