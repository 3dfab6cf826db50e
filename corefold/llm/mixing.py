"""A mix of sources with target shares of the total size, from texts that may belong to several sources.

Method: minimum-cost flow. Equal texts are one text; its membership pattern is the set of listed
sources that hold it. The sizes summed by pattern flow, in one layer per repetition, to the sources'
quotas; a layer costs more than the one before, so no text is repeated while another one that could serve is
unused (convex costs). The flow's share of a pattern and layer is then turned into a range of the pattern's
texts in seeded order, and what rounding to whole texts leaves of a quota is topped up with further uses.

Scale: the flow has one node per observed pattern and repetition, and is solved on the driver. Beyond ``most_patterns``
patterns only the largest keep all their sources there; a text of another pattern counts for one of its sources. The
seeded order is a running sum by bucket of the hash, so a source with a third of all texts is summed by many tasks.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corefold.runtime import stash

_BUCKET_ROWS = 500_000
_BROADCAST_ROWS = 100_000
REACHABLE = "reachable"


def mix(
    records: DataFrame, targets: DataFrame, total: int | str | None = None, seed: int = 7, most_patterns: int = 20_000
) -> tuple[DataFrame, DataFrame]:
    """(selection, report). records: (id, source, f, g, size) with f and g the text's fingerprint; targets: (source, target_share, max_repeats).

    selection: (id, source, uses, size), the records to use and how often. A text counts once for all
    its copies: it is used at most as often as the smallest ``max_repeats`` of its sources allows, as the
    record with the smallest id in each source that uses it. report: one row per target with
    its quota, what was reached, and whether it falls short by more than one text could make up.
    total: size of the mix; by default the size of all distinct texts of listed sources. ``REACHABLE``: the largest
    size at which all sources that have any text reach their quotas. Quotas that
    sources cannot fill stay unfilled rather than shift to others. Records of other or null sources, null
    ids and sizes of 0 take no part. Without records the selection is empty and every target short.
    """
    spark = records.sparkSession
    goal = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    rows = goal.orderBy("source").collect()  # one row per source
    names, shares, repeats = [r["source"] for r in rows], [r["share"] or 0.0 for r in rows], [max(0, r["repeats"] or 0) for r in rows]
    index = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("source")).cast("int") - 1
    listed = records.where(F.col("id").isNotNull() & F.col("source").isin(names) & (F.col("size") > 0)).select("id", index.alias("i"), "f", "g", "size")
    in_source = listed.groupBy("f", "g", "i").agg(F.min("id").alias("id"), F.max("size").cast("long").alias("size"))
    texts = in_source.groupBy("f", "g").agg(F.array_sort(F.collect_list(F.struct("i", "id"))).alias("ids"), F.max("size").alias("size"))
    cap = F.array_min(F.transform("ids", lambda x: F.get(F.array(*[F.lit(r) for r in repeats]), x["i"])))
    texts = texts.select("f", "g", "ids", "size", F.array_join(F.col("ids")["i"].cast("array<string>"), ",").alias("pattern"), cap.alias("cap"), F.xxhash64(F.lit(seed), "f", "g").alias("h"))
    texts = stash(texts, "texts")
    texts, patterns = _patterns(texts, most_patterns)

    whole = sum(size for size, _, _ in patterns.values())
    if total == REACHABLE:
        present = {i for _, members, cap in patterns.values() if cap for i in members}
        whole = _reachable(patterns, shares, present, whole * max([1, *repeats]))
    elif total is not None:
        whole = total
    quotas = [int(round(share * whole)) for share in shares]
    ranges, at = [], {}
    for (pattern, layer, i), amount in sorted(route(patterns, quotas).items()):
        low = at.get((pattern, layer), 0)
        at[pattern, layer] = low + amount
        ranges.append((pattern, i, float(low), float(low + amount)))
    chosen = spark.createDataFrame(ranges, "pattern string, i int, lo double, hi double")
    chosen = F.broadcast(chosen) if len(ranges) <= _BROADCAST_ROWS else chosen
    placed = _positions(texts, "pattern").join(chosen, "pattern").where("mid >= lo and mid < hi")
    used = stash(placed.groupBy("f", "g", "i").agg(F.count(F.lit(1)).alias("uses")), "used")
    uses = _topped_up(texts, used, quotas)
    own = F.filter("ids", lambda x: x["i"] == F.col("i"))[0]["id"]
    selection = texts.select("f", "g", "ids", "size").join(uses, ["f", "g"])
    selection = selection.select(own.alias("id"), F.get(F.array(*[F.lit(x) for x in names]), F.col("i")).alias("source"), "uses", "size")
    return selection, _report(spark, selection, list(zip(names, shares, quotas)))


def _patterns(texts: DataFrame, most: int) -> tuple[DataFrame, dict[str, tuple[int, tuple[int, ...], int]]]:
    """The texts, and size, sources and cap of every pattern; where there are too many, texts of the smaller ones are those of their first source."""
    sums = texts.groupBy("pattern").agg(F.sum("size").alias("size"), F.min("cap").alias("cap"))
    large = sums.orderBy(F.col("size").desc(), "pattern").limit(most + 1).collect()
    if len(large) > most:
        kept = texts.sparkSession.createDataFrame([(r["pattern"],) for r in large[:most]], "kept string")
        first = F.concat_ws("@", F.substring_index("pattern", ",", 1), "cap")  # the cap stays that of all the text's sources
        marked = texts.join(F.broadcast(kept), F.col("pattern") == F.col("kept"), "left")
        texts = stash(marked.withColumn("pattern", F.when(F.col("kept").isNull(), first).otherwise(F.col("pattern"))).drop("kept"), "texts")
        large = texts.groupBy("pattern").agg(F.sum("size").alias("size"), F.min("cap").alias("cap")).collect()
    members = lambda pattern: tuple(map(int, pattern.split("@")[0].split(",")))
    return texts, {r["pattern"]: (r["size"], members(r["pattern"]), r["cap"]) for r in large}


def _reachable(patterns: dict, shares: list[float], present: set[int], most: int) -> int:
    """The largest total at which the flow fills the quotas of all sources present."""
    quotas = lambda total: [int(round(x * total)) if i in present else 0 for i, x in enumerate(shares)]
    low, high = 0, most
    while low < high:
        total = (low + high + 1) // 2
        wanted = quotas(total)
        if sum(route(patterns, wanted).values()) == sum(wanted):
            low = total
        else:
            high = total - 1
    return low


def _topped_up(texts: DataFrame, used: DataFrame, quotas: list[int]) -> DataFrame:
    """(f, g, i, uses): ``used``, and for sources below their quota further uses of texts that have some left, to within half a text."""
    spark = texts.sparkSession
    sums = texts.select("f", "g", "size").join(used, ["f", "g"]).groupBy("i").agg(F.sum(F.col("size") * F.col("uses")).alias("n")).collect()
    reached = {r["i"]: r["n"] for r in sums}
    gaps = [(i, q - reached.get(i, 0)) for i, q in enumerate(quotas) if q > reached.get(i, 0)]
    if not gaps:
        return used
    left = used.groupBy("f", "g").agg(F.sum("uses").alias("uses"))
    spare = texts.join(left, ["f", "g"], "left").where(F.col("cap") > F.coalesce("uses", F.lit(0)))
    gap = F.broadcast(spark.createDataFrame(gaps, "i int, gap long"))  # at most one row per source
    # a text serves one source only here, its first below the quota, so that no use is given twice
    spare = spare.select("f", "g", "size", "h", F.explode("ids.i").alias("i")).join(gap, "i")
    spare = stash(spare.groupBy("f", "g").agg(F.min(F.struct("i", "gap", "size", "h")).alias("s")).select("f", "g", "s.*"), "spare")
    more = _positions(spare, "i").where("mid < gap").select("f", "g", "i", F.lit(1).cast("long").alias("uses"))
    return stash(used.unionByName(more).groupBy("f", "g", "i").agg(F.sum("uses").alias("uses")), "uses")


def _positions(texts: DataFrame, key: str) -> DataFrame:
    """Add mid: the middle of the text in the running sum of sizes over the seeded order of its ``key``. texts: a written table."""
    most = texts.groupBy(key).count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    bits = max(0, math.ceil(math.log2(most / _BUCKET_ROWS)))
    marked = texts.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    sums = marked.groupBy(key, "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(key, "bucket").orderBy("h", "f", "g").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("upto", F.sum("size").over(inside)).join(offsets, [key, "bucket"])
    return placed.withColumn("mid", F.col("offset") + F.col("upto") - F.col("size") / 2)


def _report(spark, selection: DataFrame, wanted: list[tuple]) -> DataFrame:
    goal = spark.createDataFrame(wanted, "source string, target_share double, quota long")
    got = selection.groupBy("source").agg(F.sum(F.col("size") * F.col("uses")).alias("reached"), F.count(F.lit(1)).alias("texts"), F.sum("uses").alias("uses"), F.max("size").alias("longest"))
    zero = F.lit(0).cast("long")
    both = goal.join(got, "source", "left").select("source", "target_share", "quota", *[F.coalesce(c, zero).alias(c) for c in ("reached", "texts", "uses", "longest")])
    whole = F.sum("reached").over(Window.partitionBy())  # one row per target
    short = F.col("reached") + F.greatest("longest", F.lit(1)) <= F.col("quota")
    return both.withColumn("reached_share", F.when(whole > 0, F.col("reached") / whole).otherwise(0.0)).withColumn("short", short).drop("longest")


def route(patterns: dict[str, tuple[int, tuple[int, ...], int]], quotas: list[int]) -> dict[tuple[str, int, int], int]:
    """(pattern, layer, source) -> amount: a minimum-cost maximum flow from patterns to quotas, the r-th use of a text at cost r - 1.

    patterns: name -> size of its texts, numbers of its sources, how often a text may be used. Successive shortest paths in the residual graph.
    """
    nodes: dict = {"in": 0, "out": 1}
    edges: list[list] = []  # [to, capacity, cost]; an edge's reverse is at its number ^ 1
    out: list[list[int]] = [[], []]

    def node(name) -> int:
        if name not in nodes:
            nodes[name] = len(out)
            out.append([])
        return nodes[name]

    def edge(a: int, b: int, capacity: int, cost: int) -> int:
        out[a].append(len(edges))
        edges.append([b, capacity, cost])
        out[b].append(len(edges))
        edges.append([a, 0, -cost])
        return len(edges) - 2

    routes = {}
    for pattern, (size, members, cap) in sorted(patterns.items()):
        for layer in range(1, cap + 1):
            here = node((pattern, layer))
            edge(0, here, size, layer - 1)
            for i in members:
                routes[pattern, layer, i] = edge(here, node(i), size, 0)
    for i, quota in enumerate(quotas):
        edge(node(i), 1, quota, 0)
    while True:
        cost, via = [math.inf] * len(out), [-1] * len(out)
        cost[0] = 0
        queue = deque([0])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                b, capacity, price = edges[e]
                if capacity > 0 and cost[a] + price < cost[b]:
                    cost[b], via[b] = cost[a] + price, e
                    queue.append(b)
        if via[1] < 0:
            break
        path, b = [], 1
        while b:
            path.append(via[b])
            b = edges[via[b] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
    return {k: edges[e ^ 1][1] for k, e in routes.items() if edges[e ^ 1][1] > 0}
