"""Sorting at scale: slices of a global order, row numbers, pages."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from bizmetrics.session import partitions_for, planned_bytes, store_bucketed, store_once

#: Pages this close to either end are a top-k; deeper ones start from a row found by counting.
#: How a page is found never changes its rows.
SHALLOW_ROWS = 10_000
#: Keys whose place is counted in one pass, and how many are sampled to choose them from.
SPLITTERS, SAMPLED = 256, 2_000
#: Buckets a table may have, Spark's own limit.
MOST_BUCKETS = 100_000
#: Where a row stands in its slice: the low bits of its number.
PLACE_BITS = 33


def sort_keys(order: list[str], backwards: bool = False) -> list[Column]:
    """``["-date", "id"]``: a leading minus sorts that column downwards."""
    keys = []
    for name in order:
        down = name.startswith("-") != backwards
        col = F.col(name.lstrip("-"))
        keys.append(col.desc() if down else col.asc())
    return keys


def total_order(df: DataFrame, order: list[str]) -> list[str]:
    """``order`` and then every other column that can be compared: rows that still tie are equal."""
    named = {name.lstrip("-") for name in order}
    comparable = (T.AtomicType, T.NullType)
    return [*order, *[f.name for f in df.schema.fields if f.name not in named and isinstance(f.dataType, comparable)]]


def _ties(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def _cut(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """The sorted rows in slices with ``_slice`` and ``_place``, and how many slices were asked for."""
    keys = [*sort_keys(order), _ties(df)]
    slices = partitions_for(planned_bytes(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = df.repartitionByRange(slices, *keys).sortWithinPartitions(*keys)
    # One number gives both: the partition in its high bits, the place in the low ones.
    return cut.withColumn("_number", F.monotonically_increasing_id()), slices


def _unpacked(cut: DataFrame) -> DataFrame:
    return cut.withColumns({"_slice": F.shiftright("_number", PLACE_BITS),
                            "_place": F.col("_number").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}).drop("_number")


def range_slices(df: DataFrame, order: list[str]) -> DataFrame:
    """Cut the globally sorted rows into consecutive slices, numbered in ``_slice``; ``_place`` is a
    row's place in its slice, from 0.

    Slices follow the whole sort key and, among equal keys, a hash of the row, so the rows
    of a hot key (or a hot timestamp) spread over as many slices as they fill. There are as many as the
    expected size asks for. They are stored by column, since their bounds come from a sample: every later
    branch has to see the same cut.
    """
    return _unpacked(store_once(_cut(df, order)[0], "slices"))


def bucketed_slices(df: DataFrame, order: list[str]) -> DataFrame:
    """Like ``range_slices``, stored so that a slice is a bucket of its own: grouping or windows by ``_bucket`` and other
    columns read whole slices and move no row. Beyond ``MOST_BUCKETS`` slices several share a bucket."""
    cut, slices = _cut(df, order)
    buckets = min(slices, MOST_BUCKETS)
    # Buckets go by hash: for each the smallest number that falls into it. Of so many tried, one is missed once in e^12.
    tried = df.sparkSession.range(buckets * (12 + buckets.bit_length())).select(F.col("id").cast("int").alias("_bucket"))
    labels = tried.groupBy(F.pmod(F.hash("_bucket"), F.lit(buckets)).alias("_nth")).agg(F.min("_bucket").alias("_bucket"))
    # Broadcast is safe: at most ``MOST_BUCKETS`` pairs of numbers. A bucket that was missed shares another's.
    numbered = _unpacked(cut).withColumn("_nth", F.col("_slice") % buckets)
    labelled = numbered.join(F.broadcast(labels), "_nth", "left").withColumn("_bucket", F.coalesce("_bucket", F.lit(0))).drop("_nth")
    return store_bucketed(labelled, "slices", "_bucket", buckets)


def slice_offsets(slices: DataFrame) -> DataFrame:
    """Rows before each slice. One row per slice, so at most one per shuffle partition."""
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return (slices.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"))
            .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))))


def global_row_number(df: DataFrame, order: list[str], out: str = "row_number") -> DataFrame:
    """1-based position in the global order, without a single-task window and with one shuffle."""
    slices = range_slices(df, total_order(df, order))
    # Broadcast is safe: offsets hold one row per shuffle partition.
    return (slices.join(F.broadcast(slice_offsets(slices).select("_slice", "_before")), "_slice")
            .withColumn(out, F.col("_before") + F.col("_place") + 1)
            .drop("_slice", "_place", "_before"))


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    number: int
    page_count: int
    row_count: int
    start_index: int
    end_index: int

    def described(self) -> DataFrame:
        """The rows with the page's numbers as columns."""
        facts = ("number", "page_count", "row_count", "start_index", "end_index")
        return self.rows.withColumns({f"page_{k}".replace("page_page", "page"): F.lit(getattr(self, k)).cast("bigint")
                                      for k in facts})


def page_number(asked: object, page_count: int) -> int:
    """Not a whole number: first page. Below 1 or beyond the end: last page. A function is asked with the
    number of pages."""
    asked = asked(page_count) if callable(asked) else asked
    try:
        number = int(asked) if float(asked).is_integer() else 1
    except (TypeError, ValueError, OverflowError):
        return 1
    return number if 1 <= number <= page_count else page_count


def page(df: DataFrame, order: list[str], number: object = 1, size: int = 20) -> Page:
    """One page of the sorted rows. Rows that tie in ``order`` are told apart by their other columns, so the
    pages hold every row once, whatever the order and however deep the page."""
    total = df.count()
    pages = max(1, math.ceil(total / size))
    n = page_number(number, pages)
    first, last = (n - 1) * size, min(n * size, total)
    full = total_order(df, order)
    if last <= SHALLOW_ROWS:
        rows = df.orderBy(*sort_keys(full)).offset(first).limit(size)
    elif total - first <= SHALLOW_ROWS:
        tail = df.orderBy(*sort_keys(full, backwards=True)).limit(total - first)
        rows = tail.orderBy(*sort_keys(full)).limit(size)
    else:
        rows = _middle(df, order, full[len(order):], first, last - first, total)
    return Page(rows, n, pages, total, first + 1 if total else 0, last)


@dataclass(frozen=True)
class Spot:
    """A key (values by column), how many rows stand before it and how many are equal to it."""
    key: dict
    before: int
    equal: int


def _constants(df: DataFrame, order: list[str], keys: list[dict]) -> list[Column]:
    """For each sort column the values of some keys, as a constant array."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = [name.lstrip("-") for name in order]
    return [F.array(*[F.lit(k[n]).cast(kinds[n]) for k in keys]) for n in names]


def _against(order: list[str], values: list[Column]) -> tuple[Column, Column]:
    """(whether a row is sorted before some key, whether it equals it); nulls come first upwards and last downwards."""
    before, equal = F.lit(False), F.lit(True)
    for name, value in reversed(list(zip(order, values))):
        col = F.col(f"`{name.lstrip('-')}`")
        ahead = F.coalesce(col > value, col.isNotNull() & value.isNull()) if name.startswith("-") else F.coalesce(col < value, col.isNull() & value.isNotNull())
        same = col.eqNullSafe(value)
        before, equal = ahead | (same & before), same & equal
    return before, equal


def _from(df: DataFrame, order: list[str], key: dict | None, behind: bool = False) -> DataFrame:
    """Rows from ``key`` on, or those behind it."""
    if key is None:
        return df
    before, equal = _against(order, [F.get(v, F.lit(0)) for v in _constants(df, order, [key])])
    return df.where(~(before | equal if behind else before))


def _upto(df: DataFrame, order: list[str], key: dict | None) -> DataFrame:
    """Rows before ``key``."""
    return df if key is None else df.where(_against(order, [F.get(v, F.lit(0)) for v in _constants(df, order, [key])])[0])


def _counted(df: DataFrame, order: list[str], splitters: list[dict]) -> list[tuple[dict, int, int]]:
    """Each of the sorted ``splitters`` with the rows between the one before and it, and the rows equal to it. A row finds
    its place among them by halving steps over constant arrays."""
    if not splitters:
        return []
    arrays = _constants(df, order, splitters)
    steps = [1 << b for b in range(len(splitters).bit_length() - 1, -1, -1)]

    def step(place: Column, width: Column) -> Column:
        ahead, _ = _against(order, [F.get(v, place + width - 1) for v in arrays])
        return F.when((place + width <= len(splitters)) & ~ahead, place + width).otherwise(place)

    placed = df.select(*df.columns, F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step).alias("_place"))
    equal = _against(order, [F.get(v, F.col("_place") - 1) for v in arrays])[1] & (F.col("_place") > 0)
    # Behind splitter i - 1 (0: before all), or equal to it.
    counts = {(r[0], r[1]): r[2] for r in placed.groupBy("_place", equal.alias("_equal")).count().collect()}
    return [(s, counts.get((i, False), 0), counts.get((i + 1, True), 0)) for i, s in enumerate(splitters)]


def _found(df: DataFrame, order: list[str], first: int, total: int) -> Spot | None:
    """A key of ``order`` close before the row in place ``first``, or the one it has itself; None for the very beginning. Keys
    are sampled and their rows counted, again and again between the two around the place; ``df`` has no other columns."""
    columns, below, done, above, until, finer = df.columns, None, 0, None, total, 1
    equal = 0
    while first - done > SHALLOW_ROWS and (below is None or first - done >= equal):
        within = _upto(_from(df, order, below), order, above)
        # Chosen by the hash of the sort columns, equal keys once: about SAMPLED of them, whatever the size.
        every = max(1, (until - done) // (SAMPLED * finer))
        chosen = within.where(F.pmod(F.xxhash64(*columns, F.lit(done)), F.lit(every)) == 0)
        sample = [r.asDict() for r in chosen.distinct().orderBy(*sort_keys(order)).collect()]
        picked = sorted({len(sample) * i // SPLITTERS for i in range(SPLITTERS)}) if sample else []
        spots, start = [], done
        for key, between, same in _counted(within, order, [sample[i] for i in picked]):
            spots.append(Spot(key, start + between, same))
            start += between + same
        was = (below, above, done)
        if lower := [x for x in spots if x.before <= first]:
            below, done, equal = lower[-1].key, lower[-1].before, lower[-1].equal
        if upper := [x for x in spots if x.before > first]:
            above, until = upper[0].key, upper[0].before
        if (below, above, done) == was:
            if every == 1:
                break  # no more different keys to choose from
            finer *= 8  # few different keys are left: look closer
        else:
            finer = 1
    return None if below is None else Spot(below, done, equal)


def _middle(df: DataFrame, order: list[str], ties: list[str], first: int, size: int, total: int) -> DataFrame:
    """``size`` rows from ``first`` (0-based) on, sorted by ``order`` and then by ``ties``. The search reads the columns of
    ``order``; where the page begins in a long run of equal keys it goes on inside that run, by the other columns. Only the last
    pass, a top-k from a row close before the page, reads whole rows. Wholly equal rows are passed over as one."""
    names = lambda keys: [f"`{k.lstrip('-')}`" for k in keys]
    full = [*order, *ties]
    spot = _found(df.select(*names(order)), order, first, total)
    if spot is None:
        return df.orderBy(*sort_keys(full)).offset(first).limit(size)
    key, keys, before, equal = spot.key, order, spot.before, spot.equal
    if ties and first - before > SHALLOW_ROWS and first - before < equal:
        run = df.where(_against(order, [F.get(v, F.lit(0)) for v in _constants(df, order, [key])])[1])
        if inside := _found(run.select(*names(ties)), ties, first - before, equal):
            key, keys, before, equal = {**key, **inside.key}, full, before + inside.before, inside.equal
    if keys == full and first - before > SHALLOW_ROWS and first < before + equal:  # in a long run of equal rows
        same = _against(full, [F.get(v, F.lit(0)) for v in _constants(df, full, [key])])[1]
        run = df.where(same).limit(min(size, before + equal - first))
        rest = _from(df, full, key, behind=True).orderBy(*sort_keys(full)).limit(max(0, first + size - before - equal))
        return run.unionByName(rest).orderBy(*sort_keys(full))
    return _from(df, keys, key).orderBy(*sort_keys(full)).offset(first - before).limit(size)
