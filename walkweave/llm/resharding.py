"""Resharding by minimum-cost flow.

Rows lie in old shards (by a hash of their id).  The new shards shall hold
numbers of rows that differ by one at most (law ``rows``).  An old shard's rows
fall into blocks by the power of two of their size.  A minimum-cost flow from
the blocks to the new shards' capacities, where a row that stays costs nothing
and one that moves costs its block's mean size, decides how many rows of each
block go where; so the fewest bytes move, up to the blocks' resolution.  A
row's rank in its block, the largest first, then gives its shard and its slot
there: the largest stay, the smallest move.

Only counts come to the driver: at most (old shards x size classes) of them.
Ranks are running counts over sub-blocks, each small enough for one task: the
32 ranges of sizes of a class, each dealt by hash.

Rows of equal texts go wherever the flow has room for them: law ``rows`` allows
no shard two rows more than another, so a group of copies can't stay together.

Edge cases: a null text has size 16 and the CRC of nothing; null ids lie in one
old shard; rows that are equal in all of id, size and CRC share a sub-block, in
any order among themselves; with fewer rows than shards some shards hold one row
and the others none; extra columns are ignored; an empty table gives an empty
one.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from walkweave.spark import remove


class Flow:
    """A minimum-cost flow by successive shortest paths with potentials."""

    def __init__(self) -> None:
        self.head: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []
        self.out: dict[object, list[int]] = defaultdict(list)
        self.number: dict[object, int] = {}
        self.adjacent: list[list[int]] = []

    def node(self, name: object) -> int:
        if name not in self.number:
            self.number[name] = len(self.number)
            self.adjacent.append([])
        return self.number[name]

    def edge(self, a: object, b: object, capacity: int, cost: int) -> int:
        """Adds an edge and its reverse; returns the edge's number."""
        at = len(self.head)
        for tail, tip, room, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.adjacent[self.node(tail)].append(len(self.head))
            self.head.append(self.node(tip))
            self.left.append(room)
            self.cost.append(price)
        return at

    def used(self, edge: int) -> int:
        return self.left[edge ^ 1]

    def solve(self, source: object, sink: object) -> int:
        """Pushes as much as fits at the least cost; returns the cost."""
        s, t, n = self.node(source), self.node(sink), len(self.number)
        potential, total = [0] * n, 0
        while True:
            distance: list[float] = [math.inf] * n
            via = [-1] * n
            distance[s] = 0
            heap = [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > distance[u]:
                    continue
                for e in self.adjacent[u]:
                    v = self.head[e]
                    if self.left[e] and (new := d + self.cost[e] + potential[u] - potential[v]) < distance[v]:
                        distance[v], via[v] = new, e
                        heapq.heappush(heap, (new, v))
            if via[t] < 0:
                return total
            for v in range(n):
                if distance[v] < math.inf:
                    potential[v] += int(distance[v])
            # All paths of this length are used up together: a blocking flow over edges without reduced cost.
            while (pushed := self._push(s, t, potential)) > 0:
                total += pushed * (potential[t] - potential[s])

    def _push(self, s: int, t: int, potential: list[int]) -> int:
        via = [-1] * len(self.number)
        via[s] = -2
        queue = [s]
        for u in queue:
            for e in self.adjacent[u]:
                v = self.head[e]
                if via[v] == -1 and self.left[e] and self.cost[e] + potential[u] - potential[v] == 0:
                    via[v] = e
                    queue.append(v)
        if via[t] == -1:
            return 0
        room, v = None, t
        while v != s:
            room = self.left[via[v]] if room is None else min(room, self.left[via[v]])
            v = self.head[via[v] ^ 1]
        v = t
        while v != s:
            self.left[via[v]] -= room
            self.left[via[v] ^ 1] += room
            v = self.head[via[v] ^ 1]
        return room


def transfers(blocks: dict[tuple[int, int], tuple[int, int]], shards: int) -> tuple[dict[tuple[int, int], dict[int, int]], int]:
    """How many rows of each block go to each shard, and the cost in (block-mean) bytes moved.

    ``blocks``: rows and bytes by (old shard, size class).  An old shard below
    ``shards`` lives on as the new shard of that number.
    """
    rows = sum(n for n, _ in blocks.values())
    flow, floor = Flow(), rows // shards
    stay: dict[tuple[int, int], int] = {}
    move: dict[tuple[int, int], int] = {}
    for key, (n, size) in sorted(blocks.items()):
        flow.edge("source", ("block", key), n, 0)
        if key[0] < shards:
            stay[key] = flow.edge(("block", key), ("shard", key[0]), n, 0)
        move[key] = flow.edge(("block", key), "pool", n, max(1, round(size / n)))
    fed = {}
    for j in range(shards):
        fed[j] = flow.edge("pool", ("shard", j), rows, 0)
        flow.edge(("shard", j), "sink", floor, 0)
        flow.edge(("shard", j), "odd", 1, 0)
    flow.edge("odd", "sink", rows - floor * shards, 0)
    cost = flow.solve("source", "sink")
    out = {key: ({key[0]: flow.used(e)} if (e := stay.get(key)) is not None and flow.used(e) else {}) for key in blocks}
    # What came through the pool is dealt to the shards that it fed, in order.
    wanting = [[j, flow.used(e)] for j, e in fed.items() if flow.used(e)]
    for key, e in sorted(move.items()):
        moving = flow.used(e)
        while moving:
            j, room = wanting[-1]
            n = min(moving, room)
            out[key][j] = out[key].get(j, 0) + n
            moving -= n
            wanting[-1][1] -= n
            if not wanting[-1][1]:
                wanting.pop()
    return out, cost


def reshard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", old_shards: int = 32, shards: int = 40, block_rows: int = 2048, most_parts: int = 1000) -> DataFrame:
    """Each row's new place: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = docs.count()
    parts = max(1, min(most_parts, math.ceil(rows / (block_rows * old_shards))))
    base = base.select(
        "*",
        F.pmod(F.xxhash64("doc_id"), F.lit(old_shards)).cast("int").alias("old_shard"),
        F.floor(F.log2("size")).cast("int").alias("class"),
        F.pmod(F.xxhash64("size", "text_crc32", "doc_id"), F.lit(parts)).cast("int").alias("part"),
    ).withColumn("step", F.floor(F.col("size") * 32 / F.pow(F.lit(2.0), "class")).cast("int"))
    key = ["old_shard", "class", "step", "part"]
    counts = base.groupBy(*key).agg(F.count("size").alias("n"), F.sum("size").alias("bytes"))
    totals = counts.groupBy("old_shard", "class").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()
    plan, _ = transfers({(r["old_shard"], r["class"]): (r["n"], r["bytes"]) for r in totals}, shards)
    filled: dict[int, int] = defaultdict(int)
    ranges = []
    for (old, size_class), targets in sorted(plan.items()):
        at, found = 0, []
        for j, n in sorted(targets.items(), key=lambda x: (x[0] != old, x[0])):
            found.append((at, at + n, j, filled[j]))
            at += n
            filled[j] += n
        ranges.append((old, size_class, found))
    spark = docs.sparkSession
    dealt = spark.createDataFrame(ranges, "old_shard int, class int, ranges array<struct<lo: bigint, hi: bigint, shard: int, first: bigint>>")
    before = F.sum("n").over(Window.partitionBy("old_shard", "class").orderBy(F.desc("step"), "part").rowsBetween(Window.unboundedPreceding, -1))
    # One row for each sub-block: at most old shards x size classes x 32 x most_parts.
    starts = counts.withColumn("start", F.coalesce(before, F.lit(0))).join(F.broadcast(dealt), ["old_shard", "class"]).select(*key, "start", "ranges")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("size"), "text_crc32", "doc_id")) - 1
    placed = base.withColumn("rank", rank).join(starts, key).withColumn("rank", F.col("rank") + F.col("start"))
    placed = placed.withColumn("to", F.filter("ranges", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"]))[0])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("to.shard").alias("shard"),
        (F.col("to.first") + F.col("rank") - F.col("to.lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )


def affected_shards(placed: DataFrame) -> DataFrame:
    """The shards that gain or lose rows: ``shard``."""
    moved = placed.where("shard <> old_shard")
    return moved.select("shard").union(moved.select(F.col("old_shard").alias("shard"))).distinct()


def rewrite(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the files of affected shards, rows by slot, below ``path``.

    Rows meet their places by id (null ids too), size and CRC of the text, and
    by a running number where rows share all of these: any of them may have any
    of their places.  Columns ``shard`` and ``slot`` of the input are written as
    ``own_shard`` and ``own_slot``.  Files of other shards stay as they are;
    those of affected shards that get no rows go once the others are written.
    """
    affected = affected_shards(placed)
    emptied = [r.shard for r in affected.join(placed.select("shard").distinct(), "shard", "left_anti").collect()]  # at most all shards
    same = ["__id", "__size", "__crc"]
    number = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
    place = placed.select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("text_crc32").alias("__crc"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    named = docs.withColumnsRenamed({c: f"own_{c}" for c in ("shard", "slot")})
    rows = named.withColumns({"__id": F.col(f"`{id_col}`").cast("bigint"), "__size": (F.octet_length(text) + 16).cast("bigint"), "__crc": F.crc32(text)})
    if not placed.groupBy("doc_id", "size", "text_crc32").count().where("count > 1").isEmpty():
        place, rows = place.withColumn("__n", number), rows.withColumn("__n", number)
        same = [*same, "__n"]
    place = place.join(F.broadcast(affected.withColumnRenamed("shard", "__shard")), "__shard")
    place = place.withColumnsRenamed({c: f"{c}2" for c in same})
    met = [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in same]
    found = rows.join(place, met).drop("__id", "__size", "__crc", "__n", *[f"{c}2" for c in same])
    found = found.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    found.withColumnsRenamed({"__shard": "shard", "__slot": "slot"}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for shard in emptied:
        remove(docs.sparkSession, f"{path}/shard={shard}")
