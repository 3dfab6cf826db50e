"""Items of varying length in containers of fixed capacity with little space left over.

Method: exact-complement hashing on the histogram of lengths. The longest length left starts a
container; while no single length, pair or triple that is still available fills the gap exactly,
the longest length that fits is added. Every exact combination found is consumed as often
as the counts allow. Lengths for which none exists are packed best-fit, longest first.

Scale: the plan is made from the histogram, which has at most ``capacity`` rows however many items there
are, and consists of combinations with counts, again bounded by the capacity. Items take their
places by rank within their length; ranks come from per-bucket counts, so a length that a third of all
items share is ranked by many tasks.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corefold.runtime import stash

_BUCKET_ROWS = 500_000


def pack(sizes: DataFrame, capacity: int, id_col: str = "id", size_col: str = "n_tokens") -> DataFrame:
    """(id, piece, piece_start, piece_end, n_tokens, container_id): every item's pieces and their containers.

    An item longer than the capacity is cut into pieces of the capacity and a rest; no other item is cut. Repeated
    rows of an id are one item (of the largest size, should they differ), null ids are dropped, and an item of size 0 or null is one
    piece that needs no container (null). Containers are numbered from 0. The result depends on ids and sizes only.
    """
    if not 1 <= capacity < 1 << 23:
        raise ValueError("capacity must be positive and below 2 ** 23, as lengths are coded with ranks")
    items = sizes.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.max(size_col), F.lit(0)).cast("long").alias("size"))
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("long")
    pieces = items.select("id", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * capacity
    pieces = pieces.select("id", F.col("piece").cast("int").alias("piece"), start.alias("piece_start"), F.least(F.col("size"), start + capacity).alias("piece_end"))
    pieces = stash(pieces.withColumn("n_tokens", F.col("piece_end") - F.col("piece_start")), "pieces")

    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect():  # at most `capacity` rows
        histogram[row["n_tokens"]] = row["count"]
    place = F.pandas_udf(_places(*plan_table(make_plan(histogram))), "long")
    ranked = _ranked(pieces, int(histogram.sum()))
    container = F.when(F.col("n_tokens") > 0, place(F.col("n_tokens"), F.col("rank")))
    return ranked.select(F.col("id").alias(id_col), "piece", "piece_start", "piece_end", "n_tokens", container.alias("container_id"))


def _ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Add rank: the piece's position, from 0, among those of its length."""
    buckets = max(1, total // _BUCKET_ROWS)
    marked = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    counts = marked.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("id", "piece")) - 1
    return marked.withColumn("within", within).join(offsets, ["n_tokens", "bucket"]).withColumn("rank", F.col("offset") + F.col("within"))


def make_plan(histogram: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Combinations (length -> how often in one container) and the number of containers of each; all items are used up."""
    left = histogram.copy()
    capacity = len(left) - 1
    plan = []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            found = _exact(left, longest, capacity)
            if found is None:
                break
            times = int(min(left[x] // n for x, n in found.items()))
            for x, n in found.items():
                left[x] -= n * times
            plan.append((found, times))
    return plan + _best_fit(left, capacity)


def _exact(left: np.ndarray, longest: int, capacity: int) -> dict[int, int] | None:
    """An available combination that contains ``longest`` and fills the capacity exactly."""
    rest = left.copy()
    taken = Counter([longest])
    rest[longest] -= 1
    gap = capacity - longest
    while gap:
        filled = _complement(rest, gap)
        if filled:
            return dict(taken + Counter(filled))
        fitting = np.flatnonzero(rest[: gap + 1])
        if not len(fitting):
            return None
        taken[int(fitting[-1])] += 1
        rest[fitting[-1]] -= 1
        gap -= int(fitting[-1])
    return dict(taken)


def _complement(rest: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths with the sum ``gap``, the longest first."""
    if rest[gap] > 0:
        return [gap]
    pair = _pair(rest, gap)
    if pair:
        return pair
    for a in np.flatnonzero(rest[: gap - 1])[::-1]:
        if 3 * a < gap:
            break
        rest[a] -= 1
        pair = _pair(rest, gap - int(a))
        rest[a] += 1
        if pair:
            return [int(a), *pair]
    return None


def _pair(rest: np.ndarray, total: int) -> list[int] | None:
    half = total // 2
    small = rest[1 : half + 1] > 0
    both = small & (rest[total - 1 : total - half - 1 : -1] > 0)
    if half and total == 2 * half:
        both[-1] = rest[half] > 1
    found = np.flatnonzero(both)
    return [int(total - found[0] - 1), int(found[0] + 1)] if len(found) else None


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing, whole groups of equal containers at a time."""
    open_: dict[int, list[tuple[Counter, int]]] = {}
    full = []
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                each = min(capacity // length, n)
                group, times, rest = Counter({length: each}), n // each, capacity - each * length
                n -= each * times
            else:
                held, count = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                times = min(count, n)
                if count > times:
                    open_.setdefault(gap, []).append((held, count - times))
                group, rest = held + Counter({length: 1}), gap - length
                n -= times
            if rest:
                open_.setdefault(rest, []).append((group, times))
            else:
                full.append((dict(group), times))
    return full + [(dict(group), times) for groups in open_.values() for group, times in groups]


def plan_table(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """The plan by length and first rank: (code, containers' first number, items of the length per container), sorted by code."""
    used: Counter = Counter()
    rows, base = [], 0
    for combination, times in plan:
        for length, n in combination.items():
            rows.append(((length << 40) + used[length], base, n))
            used[length] += n * times
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def _places(code: np.ndarray, base: np.ndarray, each: np.ndarray):
    def run(length: pd.Series, rank: pd.Series) -> pd.Series:
        if not len(code):
            return pd.Series(np.full(len(length), -1))
        asked = (length.to_numpy(np.int64) << 40) + rank.to_numpy(np.int64)
        k = np.maximum(np.searchsorted(code, asked, "right") - 1, 0)
        return pd.Series(base[k] + (asked - code[k]) // each[k])

    run.__annotations__ = {"length": pd.Series, "rank": pd.Series, "return": pd.Series}
    return run


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, capacity, unused tokens and the share in use."""
    used = packed.where("container_id is not null").agg(F.coalesce(F.max("container_id") + 1, F.lit(0)).cast("long").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("tokens"))
    room = F.col("containers") * capacity
    return used.select("containers", "tokens", room.alias("room"), (room - F.col("tokens")).alias("unused"), F.when(room > 0, F.col("tokens") / room).alias("fill"))
