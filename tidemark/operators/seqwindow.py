"""Skew-safe ordered operations within a series.

A plain ``Window.partitionBy(series_key).orderBy(ts)`` sends a whole series
to one task; if one series holds a third of all rows that task gets a third
of the data.  Every ordered operation here is instead computed in two
levels:

1. rows are shuffled once by ``(series_key, split)`` where ``split`` is an
   epoch-aligned time slice of fixed width (``split_s``, a parameter of every
   operator), and the operation runs locally inside each slice;
2. the last row of each slice has the slice's state (its values, its running
   total, its count ...); a window over these ends, ``span / split_s`` rows per
   series however dense the series is, carries the state to the later slices;
3. the carry is joined back on ``(series_key, split)``.  The big side is
   already hash-partitioned and sorted on that key after step 1, so the join
   shuffles only the small carry table.

Rows and ends come from one shuffle: both sides ask for the same columns (all
others than keys and order travel as one struct), so Spark sees the same
exchange twice and runs it, and everything below it, once.  Operators may so be
nested without reading their input twice a level.  The join tells
Spark that the keys of ends are not null, so the two sides agree where the input
says the same of its rows (``where(key.isNotNull())``, as the sample sources
do); rows of a null key are kept in any case, cut at slice borders.
All columns of the frame travel: select what is needed before an ordered operator.

Results are identical to the single-window formulation.  Series that are known
to be short (a sample a day, say) would give about a slice a row: with
``split_s=None`` they are ordered whole, by one window, and neither ends nor
carry are made.  A window's rows spill, so a longer series only takes longer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.timecols import bucket_index

DEFAULT_SPLIT_S = 7 * 86_400     # slice width in seconds; denser series take a smaller one


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _free(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the frame has such a column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def _whole(keys, ts: str, tiebreak) -> WindowSpec:
    return Window.partitionBy(*_cols(keys)).orderBy(ts, *(c for c in _cols(tiebreak) if c not in (*_cols(keys), ts)))


class _Slices:
    """Rows of ``df`` with their slice, as keys, order columns and one struct of the rest."""

    def __init__(self, df: DataFrame, keys, ts: str, tiebreak, split_s: int, values: dict[str, Column] | None = None):
        self.df, self.keys = df, _cols(keys)
        self.order = [ts, *(c for c in _cols(tiebreak) if c not in (*self.keys, ts))]
        self.rest = [c for c in df.columns if c not in (*self.keys, *self.order)]
        self.sb, self.row, self.end = _free(df, "__split"), _free(df, "__row"), _free(df, "__end")
        # nothing about the data is looked up while the plan is built
        self.rows = df.select(*self.keys, bucket_index(ts, split_s).alias(self.sb), *self.order,
                              F.struct(*[F.col(c) for c in self.rest], F.lit(True).alias(self.end),
                                       *[e.alias(n) for n, e in (values or {}).items()]).alias(self.row)) \
            .repartition(*self.keys, self.sb)
        self.local = Window.partitionBy(*self.keys, self.sb).orderBy(*self.order)
        self.across = Window.partitionBy(*self.keys).orderBy(self.sb)

    def value(self, name: str) -> Column:
        return F.col(self.row).getField(name) if name not in (*self.keys, *self.order) else F.col(name)

    def ends(self, rows: DataFrame) -> DataFrame:
        """The last row of each slice; asks for the whole struct, as the rows do."""
        return rows.withColumn(self.end, F.lead(self.row).over(self.local)).where(F.col(self.end).isNull()).drop(self.end)

    def carried(self, ends: DataFrame, **carry: Column) -> DataFrame:
        """One row a slice."""
        return ends.select(*self.keys, self.sb, *[c.alias(n) for n, c in carry.items()])

    def stitch(self, rows: DataFrame, carry: DataFrame, *extra: Column, drop: Sequence[str] = ()) -> DataFrame:
        """Rows with their slice's carry, in the columns of the frame, then ``extra``."""
        # the struct (never null) out of a window: what nobody asks for later would be pruned below the shuffle of the rows alone
        upto = self.local.rowsBetween(Window.unboundedPreceding, 0)
        whole = rows.withColumn(self.row, F.last(self.row).over(upto)).where(F.col(self.row).isNotNull())
        out = whole.join(carry, on=[*self.keys, self.sb], how="left")
        return out.select(*[self.value(c).alias(c) for c in self.df.columns if c not in drop], *extra)


def prev_row(df: DataFrame, keys: Sequence[str] | str, ts: str, cols: Sequence[str],
             tiebreak: Sequence[str] | str = (), prefix: str = "prev_",
             split_s: int | None = DEFAULT_SPLIT_S) -> DataFrame:
    """Add ``prev_<ts>`` and ``prev_<c>`` = the previous row of the series.

    Equivalent to ``lag(c).over(partitionBy(keys).orderBy(ts, *tiebreak))``.
    """
    if split_s is None:
        w = _whole(keys, ts, tiebreak)
        return df.select("*", *[F.lag(c).over(w).alias(prefix + c) for c in [ts, *(c for c in _cols(cols) if c != ts)]])
    s, cols = _Slices(df, keys, ts, tiebreak, split_s), _cols(cols)
    whole = F.struct(*[F.col(c) for c in s.order], F.col(s.row))
    carry = s.carried(s.ends(s.rows), __carry=F.lag(whole).over(s.across)).where(F.col("__carry").isNotNull())
    d = s.rows.withColumn("__prev", F.lag(whole).over(s.local))
    prev = F.coalesce(F.col("__prev"), F.col("__carry"))

    def earlier(c: str) -> Column:
        if c in s.keys:
            return F.when(prev.isNotNull(), F.col(c))
        return prev.getField(c) if c in s.order else prev.getField(s.row).getField(c)

    return s.stitch(d, carry, *[earlier(c).alias(prefix + c) for c in [ts, *(c for c in cols if c != ts)]])


def running_sums(df: DataFrame, keys: Sequence[str] | str, ts: str, values: dict[str, Column],
                 tiebreak: Sequence[str] | str = (), include_current: bool = True,
                 split_s: int | None = DEFAULT_SPLIT_S) -> DataFrame:
    """Add running sums (``name -> expression``) in series order.

    ``include_current=False`` gives the sum over strictly earlier rows.
    Sums of no rows are 0 (callers coalesce as they need).
    """
    if split_s is None:
        w = _whole(keys, ts, tiebreak).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
        return df.select("*", *[F.coalesce(F.sum(e).over(w), F.lit(0)).alias(n) for n, e in values.items()])
    s = _Slices(df, keys, ts, tiebreak, split_s, {"__v_" + n: e for n, e in values.items()})
    upto = s.local.rowsBetween(Window.unboundedPreceding, 0)
    earlier = s.across.rowsBetween(Window.unboundedPreceding, -1)

    def local(name: str, frame) -> Column:
        return F.coalesce(F.sum(F.col(s.row).getField("__v_" + name)).over(frame), F.lit(0))

    totals = s.ends(s.rows.withColumns({"__t_" + n: local(n, upto) for n in values}))
    carry = s.carried(totals, **{"__c_" + n: F.sum("__t_" + n).over(earlier) for n in values})
    frame = upto if include_current else s.local.rowsBetween(Window.unboundedPreceding, -1)
    d = s.rows.withColumns({"__l_" + n: local(n, frame) for n in values})
    return s.stitch(d, carry, *[(F.col("__l_" + n) + F.coalesce(F.col("__c_" + n), F.lit(0))).alias(n) for n in values])


def position(df: DataFrame, keys: Sequence[str] | str, ts: str, name: str = "pos",
             tiebreak: Sequence[str] | str = (), total_name: str | None = None,
             split_s: int | None = DEFAULT_SPLIT_S) -> DataFrame:
    """1-based position of each row within its series (row_number by ts).

    ``total_name`` also adds the number of rows of the series.
    """
    if split_s is None:
        pos = F.row_number().over(_whole(keys, ts, tiebreak)).cast("bigint").alias(name)
        if not total_name:
            return df.select("*", pos)
        every = Window.partitionBy(*_cols(keys))  # rows without a time count apart, as in slices
        timeless = F.col(ts).isNull()
        return df.select("*", pos, F.when(timeless, F.count(F.when(timeless, 1)).over(every)).otherwise(F.count(F.lit(1)).over(every)).alias(total_name))
    s = _Slices(df, keys, ts, tiebreak, split_s)
    d = s.rows.withColumn("__rn", F.row_number().over(s.local))
    earlier = s.across.rowsBetween(Window.unboundedPreceding, -1)
    carry = s.carried(s.ends(d), __off=F.sum("__rn").over(earlier), __tot=F.sum("__rn").over(Window.partitionBy(*s.keys)))
    extra = [(F.col("__rn") + F.coalesce(F.col("__off"), F.lit(0))).cast("bigint").alias(name)]
    if total_name:  # rows of a null key stay with their slice
        d = d.withColumn("__slice_n", F.count(F.lit(1)).over(Window.partitionBy(*s.keys, s.sb)))
        extra.append(F.coalesce(F.col("__tot"), F.col("__slice_n")).cast("bigint").alias(total_name))
    return s.stitch(d, carry, *extra)


def carry_forward(df: DataFrame, keys: Sequence[str] | str, ts: str, value: str,
                  name: str | None = None, tiebreak: Sequence[str] | str = (),
                  split_s: int = DEFAULT_SPLIT_S) -> DataFrame:
    """Last non-null value of ``value`` at or before each row (LOCF)."""
    s, name = _Slices(df, keys, ts, tiebreak, split_s), name or value
    upto = s.local.rowsBetween(Window.unboundedPreceding, 0)
    d = s.rows.withColumn("__loc", F.last(s.value(value), ignorenulls=True).over(upto))
    earlier = s.across.rowsBetween(Window.unboundedPreceding, -1)
    carry = s.carried(s.ends(d), __cv=F.last("__loc", ignorenulls=True).over(earlier)).where(F.col("__cv").isNotNull())
    return s.stitch(d, carry, F.coalesce(F.col("__loc"), F.col("__cv")).alias(name), drop=[name])
