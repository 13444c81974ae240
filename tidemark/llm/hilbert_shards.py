"""Operator 1, sharding [native]: Hilbert-curve ordering.

Several metadata dimensions are quantised into equi-depth cells (strings whole,
by their rank), documents are ordered by the Hilbert index of their cell, and the order is cut into runs of
equal row counts.  Neighbours on the curve are neighbours in every dimension,
so each shard covers a small box and files can be skipped on any of them.

Defined cases: null dimension values take cell 0 of their dimension; a null
text has 0 bytes; repeated rows take separate slots; ties on the curve go by a
hash of the id, the id, size and text checksum; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, saved

#: bits of each dimension; cells = 2 ** (BITS * dimensions)
BITS = 3
#: hash buckets that a cell is split into, so that one cell may hold any share of the rows
SALTS = 256
DIMENSIONS = ("doc_id", "n_chars", "lang", "source")


def is_string(df: DataFrame, col: str) -> bool:
    return dict(df.dtypes)[col] == "string"


def as_value(df: DataFrame, col: str) -> Column:
    """What is compared with the edges: strings as they are, whole; all else as a number."""
    return F.col(col) if is_string(df, col) else F.col(col).cast("double")


def string_edges(df: DataFrame, dims: list[str], n: int) -> dict[str, list[str]]:
    """Edges of string dimensions by the rank of their values: distinct values are counted and
    dealt by range, a value's rank is the rows of earlier ranges and of earlier values of its own."""
    each = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(d).alias("value")) for i, d in enumerate(dims)])
    counts = df.select(F.inline(each)).where("value IS NOT NULL").groupBy("dim", "value").agg(F.count("*").alias("n"))
    ranged = saved(counts.repartitionByRange(parts(df), "dim", "value").withColumn("range", F.spark_partition_id()), "values")
    earlier = Window.partitionBy("dim").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges, not the values
    starts = ranged.groupBy("dim", "range").agg(F.sum("n").alias("rows")) \
        .select("dim", "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"), F.sum("rows").over(Window.partitionBy("dim")).alias("total"))
    own = Window.partitionBy("dim", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranged.withColumn("own", F.sum("n").over(own)).join(F.broadcast(starts), ["dim", "range"]).withColumn("upto", F.col("start") + F.col("own"))
    reached = [F.least(F.expr(f"({rows}) * {n} div total"), F.lit(n - 1)) for rows in ("upto", "upto - n")]  # 1 / n, 2 / n, ... of all rows
    found = ranked.where(reached[0] > reached[1]).select("dim", "value").collect()
    return {d: sorted((r.value for r in found if r.dim == i), key=str.encode) for i, d in enumerate(dims)}


def edges_of(df: DataFrame, dims: tuple[str, ...], bits: int) -> dict[str, list]:
    """Each dimension's edges of equi-depth cells: 2**bits - 1 values, all that the driver sees."""
    n = 1 << bits
    asked = [round(i / n, 6) for i in range(1, n)]
    strings = [d for d in dims if is_string(df, d)]
    numeric = [d for d in dims if d not in strings]
    found = df.agg(*[F.percentile_approx(as_value(df, d), asked, 10_000).alias(d) for d in numeric]).first() if numeric else {}
    edges = string_edges(df, strings, n) if strings else {}
    return {d: edges[d] if d in edges else sorted(set(found[d] or [])) for d in dims}


def cell_of(df: DataFrame, edges: dict[str, list], bits: int) -> Column:
    """The number of a row's cell: its place between the edges of each dimension, one after the other."""
    cell = F.lit(0).cast("long")
    for d, own in edges.items():
        x, at = as_value(df, d), F.lit(0)
        for e in own:
            at = at + F.when(x > F.lit(e), 1).otherwise(0)
        cell = cell * (1 << bits) + F.when(x.isNull(), 0).otherwise(at)
    return cell


def curve_table(spark, n_dims: int, bits: int) -> DataFrame:
    """(cell, curve): the Hilbert index of every cell of a grid, by Skilling's transform."""
    df = spark.range(1 << (bits * n_dims)).withColumnRenamed("id", "cell")
    xs = [f"x{i}" for i in range(n_dims)]
    df = df.withColumns({x: F.shiftright("cell", bits * (n_dims - 1 - i)).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
                         for i, x in enumerate(xs)})
    flip = lambda c, m: F.col(c).bitwiseXOR(m)
    for level in range(bits - 1, 0, -1):
        bit, low = F.lit(1 << level).cast("long"), F.lit((1 << level) - 1).cast("long")
        for x in xs:  # undo the rotation that each set bit causes in the levels below
            hit = F.col(x).bitwiseAND(bit) != 0
            swap = flip("x0", F.col(x)).bitwiseAND(low)
            step = {"x0": F.when(hit, flip("x0", low)).otherwise(flip("x0", swap))}
            if x != "x0":
                step[x] = F.when(hit, F.col(x)).otherwise(flip(x, swap))
            df = df.withColumns(step)
    for a, b in zip(xs[:-1], xs[1:], strict=True):  # Gray code
        df = df.withColumn(b, flip(b, F.col(a)))
    rest = F.lit(0).cast("long")
    for level in range(bits - 1, 0, -1):
        rest = rest.bitwiseXOR(F.when(F.col(xs[-1]).bitwiseAND(F.lit(1 << level).cast("long")) != 0,
                                      F.lit((1 << level) - 1).cast("long")).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("rest", rest)
    curve = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for x in xs:
            curve = F.shiftleft(curve, 1).bitwiseOR(F.shiftright(flip(x, F.col("rest")), level).bitwiseAND(F.lit(1).cast("long")))
    return df.select("cell", curve.alias("curve"))


def hilbert_shards(docs: DataFrame, shards: int = 24, dims: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, curve, shard, slot.

    The place of a row in the whole order is the rows of earlier cells, plus
    the rows of earlier hash buckets of its cell, plus its place within its
    bucket.  Only the last needs a sort, and that of one bucket of one cell.
    The tables of cells and buckets have a fixed number of rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    edges = edges_of(docs, dims, bits)  # asked once: two approximate answers may differ
    cell, salt = cell_of(docs, edges, bits), F.pmod(F.xxhash64("doc_id", F.crc32(text.cast("binary"))), F.lit(SALTS))
    placed = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"), cell.alias("cell"), salt.alias("salt"))
    buckets = docs.select(cell.alias("cell"), salt.alias("salt")).groupBy("cell", "salt").agg(F.count("*").alias("n"))
    curve = F.broadcast(curve_table(spark, len(dims), bits))  # 2 ** (bits * dimensions) rows
    counted = buckets.groupBy("cell").agg(F.sum("n").alias("n")).join(curve, "cell")
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)  # over the cells, not the rows
    cells = counted.select("cell", "curve", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_start"),
                           F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("cell").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("cell", "salt", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("salt_start")) \
        .join(F.broadcast(cells), "cell")
    own = Window.partitionBy("cell", "salt").orderBy("doc_id", "size", "text_crc32")
    place = F.col("cell_start") + F.col("salt_start") + F.col("own") - 1
    ranked = placed.withColumn("own", F.row_number().over(own)).join(starts, ["cell", "salt"])
    return ranked.withColumn("place", place).withColumn("shard", F.expr(f"place * {shards} div total")) \
        .withColumn("first", F.expr(f"(shard * total + {shards} - 1) div {shards}")) \
        .select("doc_id", "size", "text_crc32", "curve", F.col("shard").cast("int").alias("shard"),
                (F.col("place") - F.col("first")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, **how) -> DataFrame:
    """Write whole rows as one folder per shard, in curve order, and return each
    shard's box: rows, bytes, least and greatest value of every dimension.  ``docs`` may have
    columns of any names but ``_shard`` and ``_slot``."""
    if {c.lower() for c in docs.columns} & {"_shard", "_slot"}:
        raise ValueError("docs has a column _shard or _slot")
    dims = how.get("dims", DIMENSIONS)
    places = hilbert_shards(docs, **how).select("doc_id", "text_crc32", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"),
                                                F.row_number().over(Window.partitionBy("doc_id", "text_crc32").orderBy("shard", "slot")).alias("_copy"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_crc"))
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "_crc").orderBy("doc_id")))
    same = F.expr("_crc = text_crc32 AND r._copy = p._copy") & F.col("r.doc_id").eqNullSafe(F.col("p.doc_id"))
    out = rows.alias("r").join(places.alias("p"), same).select("row.*", "_shard", "_slot")
    out.repartition("_shard").sortWithinPartitions("_shard", "_slot").drop("_slot").write.partitionBy("_shard").parquet(path)
    kept = docs.sparkSession.read.parquet(path)
    return kept.groupBy("_shard").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"),
                                      *[F.min(d).alias(f"min_{d}") for d in dims], *[F.max(d).alias(f"max_{d}") for d in dims])
