"""Column-first expression surface: derived metrics and fleet search.

User lambdas receive a tracer instead of a Python dict.  ``m['x']`` returns a
Column, so ``lambda m: F.try_divide(m['get_hits'], m['cmd_get']) * 100`` is
traced once on the driver and runs inside Catalyst (no Python UDF).  The
tracer records which metrics are used so the long form is pivoted only for
those metrics.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from .aggregate import max_floor0
from .seqwindow import DEFAULT_SPLIT_S, prev_row, running_sums


class Safe(ClassicColumn):
    """A Column whose arithmetic gives null where it fails (division by zero, overflow)."""

    @staticmethod
    def _of(c: Column) -> Safe:
        return Safe(c._jc)

    @staticmethod
    def _arg(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    def __add__(self, o): return self._of(F.try_add(self, self._arg(o)))  # noqa: E704
    def __radd__(self, o): return self._of(F.try_add(self._arg(o), self))  # noqa: E704
    def __sub__(self, o): return self._of(F.try_subtract(self, self._arg(o)))  # noqa: E704
    def __rsub__(self, o): return self._of(F.try_subtract(self._arg(o), self))  # noqa: E704
    def __mul__(self, o): return self._of(F.try_multiply(self, self._arg(o)))  # noqa: E704
    def __rmul__(self, o): return self._of(F.try_multiply(self._arg(o), self))  # noqa: E704
    def __truediv__(self, o): return self._of(F.try_divide(self, self._arg(o)))  # noqa: E704
    def __rtruediv__(self, o): return self._of(F.try_divide(self._arg(o), self))  # noqa: E704


class MetricRow:
    """``m['metric']`` -> the metric of the pivoted row; ``m.prev('metric')`` -> its value at the
    row before, ``m.prev_sum`` / ``m.prev_mean`` / ``m.prev_count`` -> over all earlier rows."""

    def __init__(self):
        self.used: list[str] = []
        self.last: set[str] = set()
        self.running: set[str] = set()

    def __getitem__(self, name: str) -> Safe:
        if name not in self.used:
            self.used.append(name)
        return Safe(F.col(f"`{name}`")._jc)

    def prev(self, name: str) -> Safe:
        self[name]
        self.last.add(name)
        return Safe(F.col(f"`prev_{name}`")._jc)

    def prev_sum(self, name: str) -> Safe:
        self[name]
        self.running.add(name)
        return Safe(F.col(f"`sum_{name}`")._jc)

    def prev_count(self, name: str) -> Safe:
        self[name]
        self.running.add(name)
        return Safe(F.col(f"`n_{name}`")._jc)

    def prev_mean(self, name: str) -> Safe:
        return self.prev_sum(name) / self.prev_count(name)


def pivot_metrics(long_df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("entity", "tbl", "ts")) -> DataFrame:
    """Long -> wide for the given metrics only (conditional aggregation in one pass)."""
    d = long_df.where(F.col("metric").isin(list(metrics)))
    return d.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def derive(long_df: DataFrame, title: str, *fns, keys: Sequence[str] = ("entity", "tbl", "ts"),
           split_s: int | None = DEFAULT_SPLIT_S) -> DataFrame:
    """Derived metric: the *last* callable given wins.  Arithmetic that fails gives null.
    Earlier rows (``m.prev...``) are those of the same keys without the time, in time order."""
    m = MetricRow()
    col = [f for f in fns if callable(f)][-1](m)
    wide = pivot_metrics(long_df, m.used, keys)
    series, ts = list(keys[:-1]), keys[-1]
    if m.last:
        wide = prev_row(wide, series, ts, sorted(m.last), split_s=split_s).drop(f"prev_{ts}")
    if m.running:
        values = {f"sum_{x}": F.col(f"`{x}`") for x in sorted(m.running)}
        values |= {f"n_{x}": F.when(F.col(f"`{x}`").isNotNull(), 1).otherwise(0) for x in sorted(m.running)}
        wide = running_sums(wide, series, ts, values, include_current=False, split_s=split_s)
    return wide.select(*keys, F.lit(title).alias("item_title"), col.cast("double").alias("value"))


class SeriesAggs:
    """Aggregate tracer for fleet search: ``a.max('x')``, ``a.min('x')``,
    ``a.avg('x')``, ``a.count('x')`` (the store's count = sum).  A metric that
    a key does not have counts as 0."""

    def __init__(self):
        self.used: list[str] = []

    def _v(self, name: str) -> Column:
        if name not in self.used:
            self.used.append(name)
        return F.when(F.col("metric") == name, F.col("value"))

    def max(self, name: str) -> Column:
        return max_floor0(self._v(name))

    def min(self, name: str) -> Column:
        return F.coalesce(F.min(self._v(name)), F.lit(0.0))

    def count(self, name: str) -> Column:
        return F.coalesce(F.sum(self._v(name)), F.lit(0.0))

    total = count

    def avg(self, name: str) -> Column:
        pts = F.count(F.when(F.col("metric") == name, F.lit(1)))
        return F.coalesce(F.try_divide(F.sum(self._v(name)), pts), F.lit(0.0))


def fleet_search(long_df: DataFrame, predicate: Callable[[SeriesAggs], Column], keys: Sequence[str] = ("entity", "tbl"),
                 output: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Keys whose aggregates satisfy ``predicate`` and their series.

    One aggregate pass (partial + final) with a conditional column for each
    metric that the predicate uses; every key of the data is tested, also
    those without these metrics.  A left-semi join then loads only the
    selected series, and ``output`` says what is made of them.  Returns
    ``(selected_keys, selected_series)``.
    """
    selected = long_df.groupBy(*keys).agg(predicate(SeriesAggs()).alias("__hit")).where("__hit").select(*keys)
    series = long_df.join(selected, list(keys), "left_semi")
    return selected, output(series) if output else series
