"""Joins on intervals and times: overlaps, stabbing queries, as-of lookups.

Overlap joins cut time into cells of several widths, each STEP times the one before: an interval
belongs to the narrowest that is not shorter than itself, so it touches two cells there at most. A pair meets in
the cells of the longer interval's width, where the shorter is filed too, and is kept only in the cell where the later of the
two starts, so it comes out once. One long interval thus widens no other's cells. Crowded cells are cut into blocks of both
sides, and each pair of blocks is joined by itself.

Concurrent pairs are counted without being made: see :func:`concurrent_counts`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import materialised

#: Between one width and the next, and widths at most.
STEP, MOST_WIDTHS = 8, 16
#: Intervals of a side that meet in one cell, about.
BLOCK = 8192
#: Intervals of a range that are counted in one task; ranges at most, after which they grow.
COUNTED, MOST_RANGES = 65_536, 256


def stab(spans: DataFrame, start: int, end: int) -> DataFrame:
    """Intervals that meet [start, end]."""
    return spans.where((F.col("start") <= end) & (F.col("end") >= start))


def _widths(spans: DataFrame, first: int | None = None) -> list[int]:
    """Cell widths from `first` (or a usual length) up to the longest."""
    row = spans.agg(F.expr("percentile_approx(`end` - `start`, 0.5)").alias("usual"), F.max(F.col("end") - F.col("start")).alias("longest")).first()
    widths = [max(1, first or int(row["usual"] or 1))]
    while widths[-1] < (row["longest"] or 1) and len(widths) < MOST_WIDTHS:
        widths.append(widths[-1] * STEP)
    widths[-1] = max(widths[-1], int(row["longest"] or 1))
    return widths


def _in_cells(spans: DataFrame, widths: list[int], prefix: str) -> DataFrame:
    """Intervals with a row for each cell that they touch of their own width (`own`) and of the wider ones."""
    length = F.col("end") - F.col("start")
    level = F.lit(len(widths) - 1)
    for k in range(len(widths) - 2, -1, -1):
        level = F.when(length <= widths[k], F.lit(k)).otherwise(level)

    def filed(k: int, width: int) -> Column:
        touched = F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))
        return F.when(F.col("__level") <= k, F.transform(touched, lambda c: F.struct(F.lit(k).alias("level"), c.alias("cell"), (F.col("__level") == k).alias("own"))))

    # an empty or reversed interval has no length; it is filed where it starts
    leveled = spans.where(F.col("end") >= F.col("start")).withColumn("__level", level)
    cells = F.flatten(F.array_compact(F.array(*[filed(k, w) for k, w in enumerate(widths)])))
    return leveled.select(*[F.col(c).alias(f"{prefix}_{c}") for c in spans.columns], F.explode(cells).alias("x")).select(*[f"{prefix}_{c}" for c in spans.columns], "x.level", "x.cell", F.col("x.own").alias(f"{prefix}__own"))


def _in_blocks(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with `l__block` and `r__block`: in a cell with many rows, a row is in one block of its side and is filed with each of the other side's."""
    sizes = [x.groupBy("level", "cell").agg(F.count(F.lit(1)).alias(n)) for x, n in ((a, "n_l"), (b, "n_r"))]
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    # a row for BLOCK rows of a side at least
    crowded = F.broadcast(sizes[0].join(sizes[1], ["level", "cell"]).where(f"n_l > {BLOCK} or n_r > {BLOCK}").select("level", "cell", blocks("n_l").alias("k_l"), blocks("n_r").alias("k_r")))

    def cut(side: DataFrame, own: str, other: str) -> DataFrame:
        row = [c for c in side.columns if c not in ("level", "cell")]
        found = side.join(crowded, ["level", "cell"], "left").withColumns({k: F.coalesce(k, F.lit(1)) for k in ("k_l", "k_r")})
        placed = found.withColumn(f"{own}__block", F.pmod(F.xxhash64(*row), F.col(f"k_{own}")).cast("int"))
        return placed.withColumn(f"{other}__block", F.explode(F.sequence(F.lit(0), F.col(f"k_{other}") - 1))).drop("k_l", "k_r")

    return cut(a, "l", "r"), cut(b, "r", "l")


def overlaps(left: DataFrame, right: DataFrame, on: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Pairs of intervals that share more than an instant, equal in the columns `on`: all columns of both with prefixes l_ and r_, and overlap_start, overlap_end."""
    widths = _widths(left.select("start", "end").unionByName(right.select("start", "end")), width)
    a, b = _in_blocks(_in_cells(left, widths, "l"), _in_cells(right, widths, "r"))
    same = (a["level"] == b["level"]) & (a["cell"] == b["cell"]) & (a["l__block"] == b["l__block"]) & (a["r__block"] == b["r__block"]) & (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.col("l__own") | F.col("r__own"))
    for c in on or []:
        same &= F.col(f"l_{c}") == F.col(f"r_{c}")
    cell = F.element_at(F.array(*[F.lit(w).cast("long") for w in widths]), a["level"] + 1)
    pairs = a.join(b, same).where(a["cell"] == F.floor(F.greatest("l_start", "r_start") / cell)).drop("level", "cell", "l__own", "r__own", "l__block", "r__block")
    return pairs.withColumn("overlap_start", F.greatest("l_start", "r_start")).withColumn("overlap_end", F.least("l_end", "r_end")).where("overlap_end > overlap_start")


def activity_overlaps(spans: DataFrame, first: str, second: str) -> DataFrame:
    """Overlaps of the intervals of two activities."""
    return overlaps(spans.where(F.col("activity") == first), spans.where(F.col("activity") == second))


def concurrent(spans: DataFrame, start: int, end: int) -> DataFrame:
    """Unordered pairs (by seq) of intervals within [start, end] that overlap, with their activities."""
    inside = stab(spans, start, end)
    return overlaps(inside, inside).where("l_seq < r_seq")


def _ordered(place: np.ndarray, code: np.ndarray, weight: np.ndarray, kinds: int) -> np.ndarray:
    """[a, b]: pairs of a row of kind a and one of kind b with a later place, by their weights."""
    order = np.argsort(place, kind="stable")
    place, code, weight = place[order], code[order], weight[order]
    first = np.searchsorted(place, place, side="left")
    out = np.zeros((kinds, kinds), dtype=np.int64)
    for kind in range(kinds):
        upto = np.concatenate(([0], np.cumsum(np.where(code == kind, weight, 0))))
        np.add.at(out[kind], code, upto[first] * weight)
    return out


def _apart(time: np.ndarray, starts: np.ndarray, place: np.ndarray, code: np.ndarray, weight: np.ndarray, kinds: int) -> np.ndarray:
    """[a, b]: pairs of which one ends (a row that is not in `starts`) before or as the other starts, of kind a where the place is less and b where it is greater.

    Places are split bit by bit: two that differ part at one bit, and there a running count in the
    order of time has the ends of the other side.
    """
    order = np.lexsort((starts, time))  # ends come before starts at one time
    starts, code, weight, place = starts[order], code[order], weight[order], np.unique(place[order], return_inverse=True)[1]
    out = np.zeros((kinds, kinds), dtype=np.int64)
    for bit in range(int(place.max(initial=0)).bit_length()):
        by = np.argsort(place >> (bit + 1), kind="stable")
        node, high, begins, c, w = place[by] >> (bit + 1), (place[by] >> bit) & 1, starts[by], code[by], weight[by]
        first = np.searchsorted(node, node, side="left")
        for side in (0, 1):
            asked = np.flatnonzero(begins & (high != side))
            for kind in np.unique(c[~begins & (high == side)]):
                upto = np.concatenate(([0], np.cumsum(np.where(~begins & (high == side) & (c == kind), w, 0))))
                found = (upto[asked] - upto[first[asked]]) * w[asked]
                np.add.at(out[kind] if side == 0 else out[:, kind], c[asked], found)
    return out


def _named(counts: np.ndarray, names: np.ndarray) -> pd.DataFrame:
    a, b = np.nonzero(counts)
    return pd.DataFrame({"l_activity": names[a], "r_activity": names[b], "n": counts[a, b]})


def _edges(df: DataFrame, column: str, ranges: int) -> np.ndarray:
    """Bounds of ranges of about equally many rows."""
    found = df.approxQuantile(column, [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    return np.unique(np.array(found, dtype=np.int64))


def concurrent_counts(spans: DataFrame, start: int, end: int) -> DataFrame:
    """l_activity, r_activity, n: the pairs of :func:`concurrent` by their activities (that of the lower seq first), counted in some n log n steps.

    Pairs that do not overlap are counted, as those of which one ends before the other starts, and taken
    from all. Ranges of seq and of time cut the plane: pairs in one range of seq are counted there by
    seq and time, others in one range of time there by time and range of seq, and the rest
    by ranges only, from the numbers of ends and starts in each.
    """
    inside = materialised(stab(spans, start, end).where("end > start and seq is not null").select("activity", "seq", "start", "end"))
    ranges = max(1, min(MOST_RANGES, -(-inside.count() // COUNTED)))
    ends = inside.select("activity", "seq", F.col("end").alias("time"), F.lit(False).alias("starts")).unionByName(inside.select("activity", "seq", F.col("start").alias("time"), F.lit(True).alias("starts")))
    by_seq, by_time = _edges(inside, "seq", ranges), _edges(ends, "time", 2 * ranges)
    in_range = lambda edges: F.pandas_udf(lambda x: pd.Series(np.searchsorted(edges, x.to_numpy(), side="right").astype("int32")), "int")
    pair = "l_activity string, r_activity string, n long"

    def in_seq(rows: pd.DataFrame) -> pd.DataFrame:
        code, names = pd.factorize(rows["activity"], use_na_sentinel=False)
        seq, one = rows["seq"].to_numpy(), np.ones(len(rows), dtype=np.int64)
        starts = np.repeat([False, True], len(rows))
        apart = _apart(np.concatenate((rows["end"], rows["start"])), starts, np.tile(seq, 2), np.tile(code, 2), np.tile(one, 2), len(names))
        return _named(_ordered(seq, code, one, len(names)) - apart, np.asarray(names))

    def in_time(rows: pd.DataFrame) -> pd.DataFrame:
        code, names = pd.factorize(rows["activity"], use_na_sentinel=False)
        return _named(-_apart(rows["time"].to_numpy(), rows["starts"].to_numpy(), rows["seq_range"].to_numpy(), code, rows["n"].to_numpy(), len(names)), np.asarray(names))

    def of_ranges(rows: pd.DataFrame) -> pd.DataFrame:
        code, names = pd.factorize(rows["activity"], use_na_sentinel=False)
        place, weight, starts, time = (rows[c].to_numpy() for c in ("seq_range", "n", "starts", "time_range"))
        every = _ordered(place[starts], code[starts], weight[starts], len(names))
        # an end comes before a start of a later range, not before one of the same
        return _named(every - _apart(2 * time + ~starts, starts, place, code, weight, len(names)), np.asarray(names))

    counted = inside.withColumn("seq_range", in_range(by_seq)("seq")).groupBy("seq_range").applyInPandas(in_seq, pair)
    if len(by_seq):
        placed = ends.select("activity", "time", "starts", in_range(by_seq)("seq").alias("seq_range"), in_range(by_time)("time").alias("time_range"))
        counted = counted.unionByName(placed.withColumn("n", F.lit(1).cast("long")).groupBy("time_range").applyInPandas(in_time, pair))
        # at most MOST_RANGES * 2 * MOST_RANGES for each activity
        cells = placed.groupBy("activity", "starts", "seq_range", "time_range").agg(F.count(F.lit(1)).alias("n"))
        counted = counted.unionByName(cells.groupBy().applyInPandas(of_ranges, pair))
    return counted.groupBy("l_activity", "r_activity").agg(F.sum("n").alias("n")).where("n > 0")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], order: str | None = None) -> DataFrame:
    """Each left row with the `values` of the last right row of the same keys at or before its time; null where there is none.

    Both sides are sorted together once per key, and the last version is carried forward: no row
    meets more than its neighbour, however many versions a key has.
    """
    found = F.struct(*[F.col(v).alias(v) for v in values])
    tie = F.col(order) if order else F.lit(0)
    versions = right.select(*keys, F.col(right_time).alias("__time"), F.lit(0).alias("__side"), tie.cast("long").alias("__order"), found.alias("__value"), F.lit(None).cast(left.select(F.struct("*").alias("x")).schema["x"].dataType).alias("__row"))
    asked = left.select(*keys, F.col(left_time).alias("__time"), F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__order"), F.lit(None).cast(versions.schema["__value"].dataType).alias("__value"), F.struct("*").alias("__row"))
    before = Window.partitionBy(*keys).orderBy("__time", "__side", "__order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = versions.unionByName(asked).withColumn("__value", F.last("__value", ignorenulls=True).over(before)).where("__side = 1")
    return carried.select("__row.*", *[F.col(f"__value.{v}").alias(v) for v in values])


def value_at(versions: DataFrame, keys: list[str], time: str, value: str, at) -> DataFrame:
    """The latest value of each key at or before one instant."""
    return versions.where(F.col(time) <= F.lit(at)).groupBy(*keys).agg(F.max_by(value, time).alias(value))
