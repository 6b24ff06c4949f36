"""Ordered computations per key that stay parallel when one key dominates.

A window function or a sorted fold hands all rows of a key to one task. A ``Timeline``
first counts rows per key; keys with more than ``limit`` rows are cut along their order
into slices of about equal row count, and a computation then runs in two levels:

1. within every (key, slice), in parallel;
2. over one summary row per slice of the hot keys, to get what each slice starts with.

The second level is joined back on (key, slice), by which the rows are already
partitioned. With no hot key there is one level and one shuffle. Results do not depend
on where the cuts fall.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..session import materialise

GROUP_ROWS = 400_000        # rows one task should take for a single key
MOST_SLICES = 20_000        # of all hot keys together; slices grow beyond that
SLICE = "_slice"
_limits: list[tuple[int, int]] = []


@contextmanager
def cut_at(limit: int, most_slices: int = MOST_SLICES):
    """Time lines made inside are cut above ``limit`` rows a key, into so many slices at most."""
    _limits.append((limit, most_slices))
    try:
        yield
    finally:
        _limits.pop()


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows, and their number of rows; at most
    ``rows / limit`` keys. The count is pre-aggregated and reads only the key columns."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") > limit))


def count_rows(df: DataFrame, keys: Sequence[str], limit: int) -> tuple[int, int]:
    """The number of rows, and of those that belong to keys with more than ``limit``."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    found = sizes.agg(F.sum(n), F.sum(F.when(n > limit, n))).first()
    return found[0] or 0, found[1] or 0


def tasks_for(df: DataFrame, rows: int, limit: int, most: int) -> int | None:
    """Partitions of half of ``limit`` rows, if those are more than Spark's setting gives:
    with a fixed number a task would hold more rows the longer the input is."""
    wanted = min(most, -(-2 * rows // limit))
    return wanted if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: DataFrame,
           rows: int, limit: int, most_slices: int) -> DataFrame:
    """The rows with a slice number: -1 for keys that are not hot.

    The rows of hot keys are dealt out by Spark's range partitioning on the keys and the
    whole order. It draws its bounds from a sample of every input partition, so a slice has
    about as many rows as any other, wherever the values lie; rows that agree in every order
    column are told apart by a digest of all columns. The dealt rows are written, so that
    every later use sees the same bounds.
    """
    slices = int(min(most_slices, max(2, -(-2 * rows // limit))))
    plain = [f.name for f in df.schema if not isinstance(f.dataType, MapType)]
    same_keys = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    named = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    dealt = (df.join(named, same_keys, "left_semi")
             .repartitionByRange(slices, *keys, *order, F.xxhash64(*plain))
             .withColumn(SLICE, F.spark_partition_id().cast("long")))
    return materialise(dealt, "slices").unionByName(
        df.join(named, same_keys, "left_anti").withColumn(SLICE, F.lit(-1).cast("long")))


# Results known to have no hot key, with the keys that were counted. Counting again would
# compute everything below once more.
_COLD: WeakKeyDictionary[DataFrame, frozenset[str]] = WeakKeyDictionary()


def inherit(df: DataFrame, source: DataFrame) -> DataFrame:
    """Carry over that no key is hot. Only for results with no more rows per key than
    ``source`` has: filtered, reduced, or with columns added."""
    if source in _COLD:
        _COLD[df] = _COLD[source]
    return df


def known_cold(df: DataFrame, keys: Sequence[str]) -> bool:
    """Groups by more columns are never larger than by fewer."""
    return df in _COLD and _COLD[df] <= set(keys)


class Timeline:
    """Rows with keys and a total order within each key.

    The order may have any number of columns; how their values are spaced has no influence
    on the slices.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 limit: int | None = None):
        self.keys, self.order = list(keys), list(order)
        inside, most_slices = _limits[-1] if _limits else (GROUP_ROWS, MOST_SLICES)
        limit = limit or inside
        self.split, self.tasks, self._dealt = False, None, False
        if not known_cold(df, self.keys):
            total, rows = count_rows(df, self.keys, limit)
            self.tasks = tasks_for(df, total, limit, most_slices)
            self.split = rows > 0
            if self.split:  # dealing reads the rows several times, so they are written first
                df = materialise(df, "rows")
                hot = hot_keys(df, self.keys, limit)
                df = sliced(df, self.keys, self.order, hot, rows, limit, most_slices)
        self._rows = df

    def _like(self, rows: DataFrame, dealt: bool | None = None) -> Timeline:
        other = object.__new__(Timeline)
        other.keys, other.order, other.split = self.keys, self.order, self.split
        other.tasks, other._dealt = self.tasks, self._dealt if dealt is None else dealt
        other._rows = rows
        return other

    def deal(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Shuffle by the columns, into so many tasks that each has about as many rows
        however long the input is."""
        return df.repartition(*([self.tasks] if self.tasks else []), *columns)

    @property
    def rows(self) -> DataFrame:
        return self.mark(self._rows.drop(SLICE) if self.split else self._rows)

    def mark(self, df: DataFrame) -> DataFrame:
        """Note on a result with the same keys that none is hot, if that is so."""
        if not self.split:
            _COLD[df] = frozenset(self.keys)
        return df

    @property
    def parts(self) -> list[str]:
        """Columns by which the rows are grouped for level one."""
        return self.keys + ([SLICE] if self.split else [])

    def map(self, change) -> Timeline:
        """Apply a row-wise change (no rows added, keys and order kept)."""
        return self._like(self._rows.transform(change))

    def where(self, condition: Column) -> Timeline:
        return self._like(self._rows.where(condition))

    def scan(self, **specs: tuple[str, Column]) -> Timeline:
        """Add running columns. Each spec is (kind, value):

        * ``lag``     value of the row before
        * ``sum``     running sum up to and including the row
        * ``before``  running sum of the rows before it (0 at the start)
        * ``count``   row number from 1
        * ``last``    last non-null value up to and including the row
        * ``earlier`` last non-null value before the row
        * ``min``     running minimum up to and including the row
        """
        window = Window.partitionBy(*self.parts).orderBy(*self.order)
        upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        prior = window.rowsBetween(Window.unboundedPreceding, -1)
        one = F.lit(1).cast("long")
        local = {
            "lag": lambda v: F.lag(F.struct(v.alias("v"))).over(window),
            "sum": lambda v: F.sum(v).over(upto),
            "before": lambda v: F.sum(v).over(prior),
            "count": lambda v: F.row_number().over(window).cast("long"),
            "last": lambda v: F.last(v, ignorenulls=True).over(upto),
            "earlier": lambda v: F.last(v, ignorenulls=True).over(prior),
            "min": lambda v: F.min(v).over(upto),
        }
        dealt = self._dealt or self.tasks is not None
        rows = (self._rows if self._dealt or not dealt
                else self.deal(self._rows, self.parts))
        work = rows.select("*", *[
            local[kind](value).alias(f"_own_{name}") for name, (kind, value) in specs.items()])
        carried = {name: F.lit(None) for name in specs}
        if self.split:
            work = work.join(self._carries(specs, one), self.parts, "left")
            carried = {name: F.col(f"_carry_{name}") for name in specs}

        def combine(name, kind):
            own, carry = F.col(f"_own_{name}"), carried[name]
            if kind == "lag":
                return F.coalesce(own, carry)["v"] if self.split else own["v"]
            if kind == "before":
                total = F.coalesce(own, F.lit(0))
                return total + F.coalesce(carry, F.lit(0)) if self.split else total
            if kind in ("sum", "count"):
                if not self.split:
                    return own
                return F.when(own.isNull() & carry.isNull(), None).otherwise(
                    F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0)))
            if kind == "min":
                return F.least(own, carry) if self.split else own
            return F.coalesce(own, carry) if self.split else own

        kept = [c for c in self._rows.columns if c not in specs]
        return self._like(work.select(
            *kept, *[combine(name, kind).alias(name) for name, (kind, _) in specs.items()]), dealt)

    def _carries(self, specs, one: Column) -> DataFrame:
        """What each slice of a hot key starts with: one row per slice."""
        at = F.struct(*self.order)
        summary = {
            "lag": lambda v: F.max_by(F.struct(v.alias("v")), at),
            "sum": F.sum,
            "before": F.sum,
            "count": lambda v: F.sum(one),
            "last": lambda v: F.max_by(v, F.when(v.isNotNull(), at)),
            "min": F.min,
        }
        summary["earlier"] = summary["last"]
        earlier = (Window.partitionBy(*self.keys).orderBy(SLICE)
                   .rowsBetween(Window.unboundedPreceding, -1))
        merge = {
            "lag": lambda c: F.last(c, ignorenulls=True).over(earlier),
            "sum": lambda c: F.sum(c).over(earlier),
            "min": lambda c: F.min(c).over(earlier),
        }
        merge["before"] = merge["count"] = merge["sum"]
        merge["last"] = merge["earlier"] = merge["lag"]
        return (
            self._rows.where(F.col(SLICE) >= 0)
            .groupBy(*self.parts)
            .agg(*[summary[kind](value).alias(f"_sum_{name}")
                   for name, (kind, value) in specs.items()])
            .select(*self.parts, *[
                merge[kind](F.col(f"_sum_{name}")).alias(f"_carry_{name}")
                for name, (kind, _) in specs.items()])
        )

    def wide(self, columns: Sequence[str]) -> DataFrame:
        """The rows with grouping, order and the named columns only."""
        return self._rows.select(*dict.fromkeys([*self.parts, *self.order, *columns]))

    def sorted_parts(self, columns: Sequence[str]) -> DataFrame:
        """Rows shuffled by (key, slice) and sorted, ready for a streaming fold."""
        return (self.deal(self.wide(columns), self.parts)
                .sortWithinPartitions(*self.parts, *self.order))
