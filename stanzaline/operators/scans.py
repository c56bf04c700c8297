"""Running values over one very large ordered group, in two phases, so that no task sorts it whole.

A group (a file, a stream, a canon) is cut into blocks of its order. Each block has a summary that adds up
(last marker, greatest value, sum, first or last row), combined before the shuffle; a small pass over the summaries
gives what goes into each block, and a window within the block does the rest. Only rows within a block meet in a task.

The cuts are every ``THIN``-th of a sample of order keys chosen by their hash; they decide how even the
blocks are and nothing else. With ``rows`` a block, raised where the table has more than ``MOST_CUTS`` of
them, there are about MOST_CUTS cuts at any size, so that cuts and carries can be broadcast.

Defined cases: a group has no need to be large, and ``group`` may be empty (the whole table is one); null groups
are one group; null orders come first, as in a window; rows that tie on the whole order stay in one block and are in no
particular order, so the order should be full; null values are skipped by ``last``, ``most`` and ``total``, whose
result before any value is null, null and 0; extra columns are kept, whatever their names; an empty table has
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and how many cuts there are at most, about; beyond that blocks grow.
BLOCK_ROWS, MOST_CUTS = 16_384, 100_000
#: Cuts in a node of the tree by which rows find their block.
FAN = 64
#: Sampled order keys for each cut: the more, the more even are the blocks.
THIN = 32


@dataclass(frozen=True)
class Fold:
    """What a row gets of the rows before it (and itself, unless ``before``) or of the one next to it."""

    kind: str
    value: Column
    before: bool = False


def last(value: Column, before: bool = False) -> Fold:
    """The last value that is not null."""
    return Fold("last", value, before)


def most(value: Column, before: bool = False) -> Fold:
    return Fold("most", value, before)


def total(value: Column, before: bool = False) -> Fold:
    return Fold("total", value, before)


def next_row(value: Column) -> Fold:
    """The value of the next row, null or not."""
    return Fold("next", value)


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names with as many underscores in front as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


class Blocks:
    """Rows with the block of their group that they are in; null for groups that need no cut."""

    def __init__(self, df: DataFrame, group: list[str], order: list[str], rows: int = BLOCK_ROWS):
        self.order, self.columns = order, df.columns
        self.block, self.one = free_names(df.columns, "_block", "_one")
        self.group = group or [self.one]
        df = df if group else df.withColumn(self.one, F.lit(0))
        n = df.count()
        self.is_cut = n > rows
        if not self.is_cut:
            self.df = df.withColumn(self.block, F.lit(None).cast("int"))
            return
        rows = max(rows, -(-n // MOST_CUTS))
        self.df = self._placed(df, self._cuts(df, rows), 2 * n // rows)

    def _placed(self, df: DataFrame, cuts: DataFrame, expected: int) -> DataFrame:
        """Rows with how many cuts are not above them, by a tree of cuts: a row meets one node of each level.

        A join copies what it finds to every row, so a node has FAN cuts at most, however many there are; but the
        top one, which has as many more as there are more cuts than expected.
        """
        names = free_names([*df.columns, self.block], "_at", "_node", "_cuts", "_key")
        at, node, own, below = names
        groups = free_names([*df.columns, self.block, *names], *(f"_g{i}" for i in range(len(self.group) + 1)))
        steps = 1
        while FAN**steps < expected:
            steps += 1
        met = df.withColumn(at, self._key()).withColumn(node, F.lit(0))
        for step in range(steps - 1, -1, -1):
            span, top = FAN**step, step == steps - 1
            level = cuts.where(F.col("n") % span == 0).withColumn("node", F.lit(0) if top else F.floor(F.col("n") / (span * FAN)).cast("int"))
            level = level.groupBy(*self.group, "node").agg(F.array_sort(F.collect_list("key")).alias(own)).withColumnsRenamed(dict(zip([*self.group, "node"], groups)))
            same = _all(F.col(c).eqNullSafe(F.col(g)) for c, g in zip([*self.group, node], groups))
            met = met.join(F.broadcast(level), same, "left")
            # halving steps, so that a row costs the logarithm of their number; at the top they reach twice as far as is expected
            most_ = 2 * expected // span + FAN if top else FAN
            halves = F.array(*(F.lit(1 << k) for k in range(most_.bit_length(), -1, -1)))
            reach = lambda done, half: F.when(F.get(own, done + half - 1) <= F.col(at), done + half).otherwise(done)
            place = F.aggregate(halves, F.lit(0), reach)
            # behind the first cut of the node found; rows below all cuts stay below, groups without cuts have no place
            if top:
                place = F.when(F.col(own).isNotNull(), place - 1)
            else:
                place = F.when(F.col(node) < 0, F.col(node)).when(F.col(own).isNotNull(), F.col(node) * FAN + place - 1)
            met = met.withColumn(below, place.cast("int")).drop(node, own, *groups).withColumnRenamed(below, node)
        return met.withColumn(self.block, F.col(node) + 1).select(*df.columns, self.block)

    def _key(self) -> Column:
        return F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(self.order)))

    def _cuts(self, df: DataFrame, rows: int) -> DataFrame:
        """(group, key, n): every THIN-th sampled key of each group that has so many, numbered from 0."""
        rate = max(1, rows // THIN)
        keys = df.select(*self.group, self._key().alias("key")).where(F.pmod(F.xxhash64(*self.group, "key"), F.lit(rate)) == 0).distinct()
        numbered = keys.withColumn("n", F.row_number().over(Window.partitionBy(*self.group).orderBy("key")))
        thin = min(THIN, rows)
        return numbered.where(F.col("n") % thin == 0).select(*self.group, "key", (F.col("n") / thin - 1).cast("int").alias("n"))

    def run(self, **folds: Fold) -> Blocks:
        """The same blocks with a column for each fold."""
        inner = Window.partitionBy(*self.group, self.block).orderBy(*self.order)
        out = self.df.withColumns({name: _local(f, inner) for name, f in folds.items()})
        if self.is_cut:
            out = self._carried(out, folds)
        out = out.withColumns({name: F.col(name)["v"] for name, f in folds.items() if f.kind == "next"})
        made = object.__new__(Blocks)
        made.__dict__.update(self.__dict__, df=out, columns=[*(c for c in self.columns if c not in folds), *folds])
        return made

    def _carried(self, out: DataFrame, folds: dict[str, Fold]) -> DataFrame:
        names = dict(zip(folds, free_names(out.columns, *(f"_carry{i}" for i in range(len(folds))))))
        sums = self.df.where(F.col(self.block).isNotNull()).groupBy(*self.group, self.block).agg(*(_summary(f, self._key()).alias(names[k]) for k, f in folds.items()))
        over = Window.partitionBy(*self.group).orderBy(self.block)
        sums = sums.select(*self.group, self.block, *(_prefix(f, F.col(names[k]), over).alias(names[k]) for k, f in folds.items()))
        keys = free_names([*out.columns, *names.values()], *(f"_g{i}" for i in range(len(self.group) + 1)))
        sums = sums.withColumnsRenamed(dict(zip([*self.group, self.block], keys)))
        same = _all(F.col(c).eqNullSafe(F.col(k)) for c, k in zip([*self.group, self.block], keys))
        met = out.join(F.broadcast(sums), same, "left")
        return met.withColumns({k: _joined(f, F.col(k), F.col(names[k])) for k, f in folds.items()}).drop(*keys, *names.values())

    def frame(self) -> DataFrame:
        return self.df.select(*self.columns)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= c
    return out


def _local(fold: Fold, w) -> Column:
    so_far = w.rowsBetween(Window.unboundedPreceding, -1 if fold.before else 0)
    if fold.kind == "last":
        return F.last(fold.value, True).over(so_far)
    if fold.kind == "most":
        return F.max(fold.value).over(so_far)
    if fold.kind == "total":
        return F.coalesce(F.sum(fold.value).over(so_far), F.lit(0))
    return F.lead(F.struct(fold.value.alias("v"))).over(w)


def _summary(fold: Fold, key: Column) -> Column:
    if fold.kind == "last":
        return F.max_by(fold.value, F.when(fold.value.isNotNull(), key))
    if fold.kind == "most":
        return F.max(fold.value)
    if fold.kind == "total":
        return F.sum(fold.value)
    return F.min_by(F.struct(fold.value.alias("v")), key)


def _prefix(fold: Fold, own: Column, over) -> Column:
    """What the blocks before (of ``next``: the block after) hand on."""
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    if fold.kind == "last":
        return F.last(own, True).over(earlier)
    if fold.kind == "most":
        return F.max(own).over(earlier)
    if fold.kind == "total":
        return F.sum(own).over(earlier)
    return F.lead(own).over(over)


def _joined(fold: Fold, own: Column, carry: Column) -> Column:
    if fold.kind == "most":
        return F.greatest(own, carry)
    if fold.kind == "total":
        return own + F.coalesce(carry, F.lit(0))
    return F.coalesce(own, carry)


def carry_forward(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """The last value that is not null, up to and with each row."""
    return Blocks(df, group, order, rows).run(**{out: last(value)}).frame()


def number(df: DataFrame, group: list[str], order: list[str], out: str = "n", rows: int = BLOCK_ROWS) -> DataFrame:
    """Places from 1 on."""
    return Blocks(df, group, order, rows).run(**{out: total(F.lit(1))}).frame()


def segments(df: DataFrame, group: list[str], order: str, is_marker: Column, text: str, joiner: str = " ", rows: int = BLOCK_ROWS) -> DataFrame:
    """Text between markers as (group, segment, body): a running count of markers numbers the segment."""
    numbered = Blocks(df.select(*group, F.col(order), F.col(text), is_marker.cast("int").alias("_marker")), group, [order], rows).run(segment=total(F.col("_marker"))).frame()
    return numbered.groupBy(*group, "segment").agg(_in_order(order, text, joiner).alias("body"))


def merge_intervals(df: DataFrame, group: list[str], start: str, end: str, tie: str, gap: int = 1, rows: int = BLOCK_ROWS) -> DataFrame:
    """Merges intervals that overlap or lie at most ``gap`` apart, as (group, low, high, n)."""
    own = df.select(*group, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(tie).alias("_t"))
    reached = Blocks(own, group, ["_s", "_e", "_t"], rows).run(_before=most(F.col("_e"), before=True))
    fresh = F.when(F.col("_before").isNull() | (F.col("_s") > F.col("_before") + gap), 1).otherwise(0)
    numbered = reached.run(_island=total(fresh)).frame()
    return numbered.groupBy(*group, "_island").agg(F.min("_s").alias("low"), F.max("_e").alias("high"), F.count("*").alias("n")).drop("_island")


def join_with_next(df: DataFrame, group: list[str], order: str, text: str, joins: Column, rows: int = BLOCK_ROWS) -> DataFrame:
    """Where ``joins`` holds, a row ends with the next row's text; rows so used up go."""
    own = df.select(*group, F.col(order), F.col(text), F.coalesce(joins, F.lit(False)).alias("_joins"))
    looked = Blocks(own, group, [order], rows).run(_next=next_row(F.col(text).isNotNull()))
    stops = F.when(F.col("_joins") & F.coalesce(F.col("_next"), F.lit(False)), 0).otherwise(1)
    chained = looked.run(_chain=total(stops, before=True)).frame()
    return chained.groupBy(*group, "_chain").agg(F.min(order).alias(order), _in_order(order, text, " ").alias(text), F.count("*").alias("parts")).drop("_chain")


def running_max_accept(df: DataFrame, group: list[str], order: list[str], key: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Greedy monotone acceptance: a row stays if its key is not below any key before it."""
    (before,) = free_names(df.columns, "_before")
    made = Blocks(df, group, order, rows).run(**{before: most(F.col(key), before=True)}).frame()
    return made.where(F.col(before).isNull() | (F.col(key) >= F.col(before))).drop(before)


def _in_order(order: str, text: str, joiner: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), joiner)
