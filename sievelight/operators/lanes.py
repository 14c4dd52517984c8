"""Ordered groups that stay parallel when one group holds most of the rows.

Views, bursts, numbering and eviction all ask for a row's position, its
neighbour or a running sum inside a group (a session, a camera, a base name).
One window per group puts a whole group into one task, which fails when a
single session holds a third of a 100 TB table. A *lane* is such a group. The
rows of every group are counted with a map-side combined count, whatever the
table's size in bytes. Where no group has more than ``rowsPerSlice`` rows a plain
window serves. Larger groups are cut into slices along the sort key
at sampled split points, and each scan runs as

1. a window per (group, slice), so no task holds more than about one slice;
2. one summary row per slice of a hot group (a combined aggregate);
3. a window over those few summaries, which carries the state from slice to slice;
4. a broadcast join of the carried state. Summaries number at most
   ``2 * MAX_SLICES``, so that broadcast is bounded whatever the table holds.

The split points are fixed before the plan that uses them runs, so a recomputed
task after a lost executor cuts its rows at the same places.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

ROWS_PER_SLICE = "spark.sievelight.rowsPerSlice"
MAX_SLICES = 32768
DEFAULT_ROWS = "4000000"
_SAMPLES_PER_SLICE = 50
_FAN = 16


def same_keys(left: list[str], right: list[str]) -> Column:
    """NULL-safe equality: rows without a key value form one group of their own."""
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


@dataclass(frozen=True)
class Scan:
    """One ordered computation, in its per-slice and its carried form."""

    local: Callable[[Lanes], Column]
    summary: Callable[[Lanes], Column]
    carry: Callable[[Column, Lanes], Column]
    combine: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] = staticmethod(lambda c: c)


def position() -> Scan:
    """1-based place of the row in its group."""
    return Scan(
        local=lambda g: F.row_number().over(g.forward).cast("bigint"),
        summary=lambda g: F.count(F.lit(1)),
        carry=lambda c, g: F.sum(c).over(g.slices_before),
        combine=lambda here, past: here + F.coalesce(past, F.lit(0)),
    )


def total() -> Scan:
    """Number of rows in the group."""
    return Scan(
        local=lambda g: F.count(F.lit(1)).over(g.whole),
        summary=lambda g: F.count(F.lit(1)),
        carry=lambda c, g: F.sum(c).over(g.all_slices),
        combine=lambda here, everything: F.coalesce(everything, here),
    )


def group_sum(expr: Column) -> Scan:
    """Sum of ``expr`` over the whole group."""
    return Scan(
        local=lambda g: F.coalesce(F.sum(expr).over(g.whole), F.lit(0)),
        summary=lambda g: F.sum(expr),
        carry=lambda c, g: F.coalesce(F.sum(c).over(g.all_slices), F.lit(0)),
        combine=lambda here, everything: F.coalesce(everything, here),
    )


def running(expr: Column) -> Scan:
    """Sum of ``expr`` over the rows up to and including this one; NULL adds nothing."""
    return Scan(
        local=lambda g: F.coalesce(F.sum(expr).over(g.upto), F.lit(0)),
        summary=lambda g: F.sum(expr),
        carry=lambda c, g: F.sum(c).over(g.slices_before),
        combine=lambda here, past: here + F.coalesce(past, F.lit(0)),
    )


def previous(expr: Column) -> Scan:
    """``expr`` of the row just before; NULL on the first row of the group."""
    return Scan(
        local=lambda g: F.lag(F.struct(expr.alias("v"))).over(g.forward),
        summary=lambda g: g.last_of(F.struct(expr.alias("v")), F.lit(True)),
        carry=lambda c, g: F.lag(c).over(g.slices),
        combine=lambda here, past: F.coalesce(here, past),
        finish=lambda c: c["v"],
    )


def last_seen(expr: Column) -> Scan:
    """Latest non-NULL ``expr`` among the rows strictly before."""
    return Scan(
        local=lambda g: F.last(expr, ignorenulls=True).over(g.before),
        summary=lambda g: g.last_of(expr, expr.isNotNull()),
        carry=lambda c, g: F.last(c, ignorenulls=True).over(g.slices_before),
        combine=lambda here, past: F.coalesce(here, past),
    )


def next_seen(expr: Column) -> Scan:
    """Earliest non-NULL ``expr`` among the rows strictly after."""
    return Scan(
        local=lambda g: F.last(expr, ignorenulls=True).over(g.after),
        summary=lambda g: g.first_of(expr, expr.isNotNull()),
        carry=lambda c, g: F.last(c, ignorenulls=True).over(g.slices_after),
        combine=lambda here, future: F.coalesce(here, future),
    )


class Lanes:
    """A DataFrame viewed as groups ``keys``, each sorted by ``order``.

    ``order`` is ascending with NULLs last; ``descending`` is its exact reverse
    (NULLs first). It has to end in a column that makes it unique.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], descending: bool = False):
        self.order, self.descending = list(order), descending
        self.keys = list(keys) or ["_one_lane"]
        self.df = df if keys else df.withColumn("_one_lane", F.lit(0))
        self.sliced = False
        self._slice(int(df.sparkSession.conf.get(ROWS_PER_SLICE, DEFAULT_ROWS)))

    # -- windows -----------------------------------------------------------

    def _spec(self, reverse: bool = False) -> WindowSpec:
        down = self.descending != reverse
        cols = [F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_last() for c in self.order]
        return Window.partitionBy(*self.group).orderBy(*cols)

    def _slice_spec(self, reverse: bool = False) -> WindowSpec:
        down = self.descending != reverse
        col = F.col("_slice")
        return Window.partitionBy(*self.keys).orderBy(col.desc() if down else col.asc())

    @property
    def group(self) -> list[str]:
        return self.keys + (["_slice"] if self.sliced else [])

    forward = property(lambda self: self._spec())
    before = property(lambda self: self._spec().rowsBetween(Window.unboundedPreceding, -1))
    upto = property(lambda self: self._spec().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The rows after are read as the rows before of the reversed order: a frame
    # that ends at the group's end costs quadratic time in Spark.
    after = property(lambda self: self._spec(True).rowsBetween(Window.unboundedPreceding, -1))
    whole = property(lambda self: Window.partitionBy(*self.group))
    slices = property(lambda self: self._slice_spec())
    slices_before = property(lambda self: self._slice_spec().rowsBetween(Window.unboundedPreceding, -1))
    slices_after = property(lambda self: self._slice_spec(True).rowsBetween(Window.unboundedPreceding, -1))
    all_slices = property(lambda self: Window.partitionBy(*self.keys))

    # -- first and last of a slice, as combinable aggregates ----------------

    def sort_key(self) -> Column:
        parts = []
        for i, c in enumerate(self.order):
            parts += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}")]
        return F.struct(*parts)

    def last_of(self, value: Column, present: Column) -> Column:
        pick = F.min_by if self.descending else F.max_by
        return pick(value, F.when(present, self.sort_key()))

    def first_of(self, value: Column, present: Column) -> Column:
        pick = F.max_by if self.descending else F.min_by
        return pick(value, F.when(present, self.sort_key()))

    # -- slicing -------------------------------------------------------------

    def _slice(self, rows_per_slice: int) -> None:
        counts = self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"))
        size = counts.agg(F.sum("_n").alias("rows"), F.max("_n").alias("largest")).first()
        if not size.rows or size.largest <= rows_per_slice:
            return
        rows_per_slice = max(rows_per_slice, math.ceil(size.rows / MAX_SLICES))
        spark = self.df.sparkSession
        names = [f"_h{i}" for i in range(len(self.keys))]
        hot_table = (
            counts.where(F.col("_n") > rows_per_slice)
            .select(*[F.col(k).alias(n) for k, n in zip(self.keys, names)],
                    F.ceil(F.col("_n") / rows_per_slice).cast("int").alias("_want"), "_n")
        ).toArrow()
        if hot_table.num_rows == 0:
            return
        hot = spark.createDataFrame(hot_table)
        wanted = hot.agg(F.sum("_want").alias("w"), F.sum("_n").alias("n")).first()
        fraction = min(1.0, _SAMPLES_PER_SLICE * wanted.w / wanted.n)
        sample = (
            self.df.select(*self.keys, self.sort_key().alias("_key"))
            .join(F.broadcast(hot), same_keys(self.keys, names))
            .where(F.rand(11) < fraction)
        )
        lane = Window.partitionBy(*names)
        rank, seen = F.row_number().over(lane.orderBy("_key")), F.count(F.lit(1)).over(lane)
        cut = F.floor(F.col("_rank") * F.col("_want") / (F.col("_seen") + 1))
        earlier = F.floor((F.col("_rank") - 1) * F.col("_want") / (F.col("_seen") + 1))
        bounds_table = (
            sample.withColumn("_rank", rank).withColumn("_seen", seen)
            .where(cut != earlier)
            .groupBy(*names).agg(F.sort_array(F.collect_set("_key")).alias("_bounds"))
        ).toArrow()
        if bounds_table.num_rows == 0:
            return
        rows = self.df.withColumns({"_slice": F.lit(0), "_hot": F.lit(False)})
        for level in _search_levels(bounds_table, names):
            children = _count_at_or_below([F.col(f"_s{i}") for i in range(1, _FAN)], self.sort_key())
            rows = (
                rows.join(F.broadcast(spark.createDataFrame(level)),
                          same_keys(self.keys, names) & (F.col("_slice") == F.col("_node")), "left")
                .withColumn("_hot", F.col("_hot") | F.col("_node").isNotNull())
                .withColumn("_slice", F.col("_slice") * _FAN + children)
                .drop(*names, "_node", *[f"_s{i}" for i in range(1, _FAN)])
            )
        self.df = rows
        self.sliced = True

    # -- public --------------------------------------------------------------

    def scan(self, **scans: Scan) -> Lanes:
        """Add one column per scan; the sort order of the lanes stays usable."""
        taken = set(scans) & {*self.keys, *self.order, "_slice", "_hot"}
        if taken:
            raise ValueError(f"scan columns would replace the lane's own: {sorted(taken)}")
        if not self.sliced:
            local = self.df.withColumns({n: s.finish(s.local(self)) for n, s in scans.items()})
        else:
            local = self.df.withColumns({n: s.local(self) for n, s in scans.items()})
            summary = (
                self.df.where("_hot").groupBy(*self.group)
                .agg(*[s.summary(self).alias(f"_s_{n}") for n, s in scans.items()])
            )
            carried = summary.select(
                *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.group)],
                *[s.carry(F.col(f"_s_{n}"), self).alias(f"_c_{n}") for n, s in scans.items()],
            )
            keys = [f"_k{i}" for i in range(len(self.group))]
            local = (
                local.join(F.broadcast(carried), same_keys(self.group, keys), "left")
                .withColumns({n: s.finish(s.combine(F.col(n), F.col(f"_c_{n}"))) for n, s in scans.items()})
                .drop(*keys, *[f"_c_{n}" for n in scans])
            )
        out = object.__new__(Lanes)
        out.__dict__.update(self.__dict__)
        out.df = local
        return out

    def with_columns(self, **cols: Column) -> Lanes:
        out = object.__new__(Lanes)
        out.__dict__.update(self.__dict__)
        out.df = self.df.withColumns(cols)
        return out

    def rows(self, *drop: str) -> DataFrame:
        return self.df.drop("_one_lane", "_slice", "_hot", *drop)


def _search_levels(bounds: pa.Table, names: list[str]) -> list[pa.Table]:
    """Split points of every hot group as the levels of one search tree.

    A row walks down by one broadcast hash join per level and four compiled
    comparisons, instead of a search through an array in an interpreted lambda.
    Node k of a level holds the split points between its children; a group with
    fewer of them has NULLs, which no key reaches.
    """
    points = bounds.column("_bounds").combine_chunks()
    starts, keys = points.offsets.to_pylist(), points.values
    sizes = [b - a for a, b in zip(starts, starts[1:])]
    depth = max(1, math.ceil(math.log(max(sizes) + 1, _FAN) - 1e-9))
    levels = []
    for level in range(depth):
        step = _FAN ** (depth - 1 - level)
        groups, nodes, at = [], [], [[] for _ in range(1, _FAN)]
        for g, n in enumerate(sizes):
            for node in range(math.ceil((n + 1) / (_FAN * step))):
                groups.append(g)
                nodes.append(node)
                for i, column in enumerate(at, 1):
                    index = (node * _FAN + i) * step - 1
                    column.append(starts[g] + index if index < n else None)
        columns = {k: bounds.column(k).take(pa.array(groups, pa.int64())) for k in names}
        columns["_node"] = pa.array(nodes, pa.int32())
        columns.update({f"_s{i}": _take(keys, column) for i, column in enumerate(at, 1)})
        levels.append(pa.table(columns))
    return levels


def _take(keys: pa.StructArray, index: list[int | None]) -> pa.StructArray:
    """Rows of ``keys``; None gives a NULL struct."""
    where = pa.array(index, pa.int64())
    fields = [pa.field(f.name, f.type) for f in keys.type]
    return pa.StructArray.from_arrays(
        [keys.field(i).take(where) for i in range(len(fields))], fields=fields, mask=where.is_null())


def _count_at_or_below(points: list[Column], key: Column) -> Column:
    """How many of the sorted ``points`` are at or below ``key``; NULL points are above all."""
    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high + 1) // 2
        return F.when(points[mid - 1] <= key, below(mid, high)).otherwise(below(low, mid - 1))

    return below(0, len(points))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], row_id: list[str],
                how: str = "left", may_lack: str | None = None) -> DataFrame:
    """Attach one row per group to its members, safe for a group of any size.

    A group with more than ``rowsPerSlice`` members gets a salt for each such
    part, its row is repeated once per salt, and members spread over the salts
    by a hash of their own id. Hot groups number at most one per
    ``rowsPerSlice`` rows, so their table is small and its broadcast bounded. Keys match NULL-safely, but
    for the key ``may_lack``: rows without it have no group, match nothing, and are spread by their id.
    """
    most = int(rows.sparkSession.conf.get(ROWS_PER_SLICE, DEFAULT_ROWS))
    hot_keys = [f"_h_{k}" for k in keys]
    members = rows if may_lack is None else rows.where(F.col(may_lack).isNotNull())
    hot = members.groupBy(*[F.col(k).alias(h) for k, h in zip(keys, hot_keys)]).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("_salts")).where("_salts > 1")
    salts = F.coalesce("_salts", F.lit(1))
    renamed = groups.join(F.broadcast(hot), same_keys(keys, hot_keys), "left").select(
        *[F.col(k).alias(f"_g_{k}") for k in keys],
        *[c for c in groups.columns if c not in keys],
        F.explode(F.sequence(F.lit(0), salts - 1)).alias("_g_salt"),
    )
    own = F.xxhash64(*row_id)
    salt = F.pmod(own, salts).cast("int")
    if may_lack is not None:
        salt = F.when(F.col(may_lack).isNull(), -1 - F.pmod(own, F.lit(1 << 20)).cast("int")).otherwise(salt)
    spread = rows.join(F.broadcast(hot), same_keys(keys, hot_keys), "left").withColumn("_salt", salt).drop("_salts", *hot_keys)
    cond = same_keys(keys, [f"_g_{k}" for k in keys]) & (F.col("_salt") == F.col("_g_salt"))
    return spread.join(renamed, cond, how).drop("_salt", "_g_salt", *[f"_g_{k}" for k in keys])
