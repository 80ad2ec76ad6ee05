import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import DOCS, documents

from walkweave.llm import resharding as R
from walkweave.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, id int, v int"


def brute(rows, k=5, every=50):
    vectors = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    asking = {}
    for i, v in vectors:
        if i % every == 0:
            asking[i] = min(asking.get(i, (v, len(v))), (v, len(v)))
    out = []
    for i, (v, _) in asking.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in vectors if j != i and len(w) == len(v))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def rows_of(seed, n=400, dim=6):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # many copies: ties
    rows += [(50, None), (51, [None] * dim), (52, [float("nan")] * dim), (53, [float("inf")] * dim), (None, rows[3][1]), (100, rows[5][1]), (7, rows[7][1]), (450, [0.0, 0.0]), (451, [1.0, 2.0]), (500, [])]
    return rows


@pytest.mark.parametrize("shard, block", [(16_384, 2_048), (40, 3)])
def test_search(spark, shard, block):
    rows = rows_of(1)
    df = spark.createDataFrame([(i, e, 0, 1, 2) for i, e in rows], SCHEMA)
    got = topk.top_k(df, shard_rows=shard, block_rows=block).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert topk.top_k(df.limit(0)).count() == 0


BIG = {
    "sums beyond doubles": [(i, [float(2**29 + i * i), -float(i), 0.5]) for i in range(0, 300, 3)],
    "sums beyond 64 bits": [(i, [float(2**40 + i), -float(i)]) for i in range(0, 300, 3)],
    "components beyond 64 bits": [(i, [(-1) ** i * 1e30 * (i + 1), 1.0, i / 7]) for i in range(0, 300, 3)],
    "products beyond doubles": [(i, [1e200 * (i % 7 - 3), float(i)]) for i in range(0, 300, 3)],
    "beyond doubles times 256": [(i, [1.7e308 if i % 2 else float(i), -1.5]) for i in range(0, 300, 3)],
    "large and small ones": [(i, [float(i), 1.0]) for i in range(200)] + [(200 + i, [1e12 * i, -3e9]) for i in range(20)],
}


@pytest.mark.parametrize("rows", BIG.values(), ids=BIG.keys())
@pytest.mark.parametrize("shard", [65_536, 16])
def test_large_components_stay_exact(spark, rows, shard):
    """Scores are exact; beyond 64 bits they count as the nearest long."""
    vectors = [(i, [256 * int(x) if abs(x) >= 2**53 else math.floor(256 * x) for x in e]) for i, e in rows]
    want = []
    for i, v in vectors:
        if i % 50 == 0:
            found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j) for j, w in vectors if j != i)
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:5])]
    df = spark.createDataFrame([(i, e, 0, 1, 2) for i, e in rows], SCHEMA.replace("float", "double"))
    got = sorted(map(tuple, topk.top_k(df, shard_rows=shard).collect()))
    assert got == sorted(want) and len(got) >= 10


def test_waves_cover_the_shards():
    for n in (0, 1, 2, 5, 64, 1000):
        assert [s for w in topk.waves(n) for s in w] == list(range(n))


def test_tree_bounds_hold():
    rng = np.random.default_rng(0)
    points = rng.integers(-200, 200, (500, 8)).astype(float)
    tree = topk.BallTree(np.arange(500), points, leaf=16)
    queries = rng.integers(-200, 200, (20, 8)).astype(float)
    bounds = tree.bounds(queries)
    for q, bound in zip(queries, bounds):
        for members, b in zip(tree.members, bound):
            assert (points[members] @ q).max() <= b


# Resharding


@pytest.mark.parametrize("rows", [DOCS, [], DOCS[:1], [(i, "x" * (i % 37) ** 2) for i in range(500)] + [(None, None), (None, "a"), (3, "x" * 9)]])
@pytest.mark.parametrize("part", [2048, 5])
def test_places(spark, rows, part):
    got = R.reshard(documents(spark, rows), block_rows=part).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 40
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1
    moved = sum(r.shard != r.old_shard for r in got)
    surplus = Counter(r.old_shard for r in got)
    floor = len(rows) // 40
    extra = sorted((max(0, n - floor) for n in surplus.values()), reverse=True)
    assert moved == sum(extra) - min(len(rows) - 40 * floor, sum(x > 0 for x in extra))


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(3)
    for _ in range(10):
        blocks = {(s, c): (n := rng.randint(1, 9), n * 2**c) for s in range(4) for c in range(4) if rng.random() < 0.8}
        shards = 6
        plan, cost = R.transfers(blocks, shards)
        total = sum(n for n, _ in blocks.values())
        filled = Counter()
        for key, targets in plan.items():
            assert sum(targets.values()) == blocks[key][0]
            filled.update(targets)
        assert all(total // shards <= filled[j] <= -(-total // shards) for j in range(shards)) and sum(filled.values()) == total
        # The cheapest rows of each old shard leave; which shards keep one row more is tried out.
        from itertools import combinations

        best = min(
            sum(sum(sorted(2**c for (s, c), (n, _) in blocks.items() if s == shard for _ in range(n))[: max(0, sum(n for (s, _), (n, _) in blocks.items() if s == shard) - total // shards - (shard in more))]) for shard in range(4))
            for more in combinations(range(shards), total % shards)
        )
        assert cost == best == sum(n * 2 ** key[1] for key, targets in plan.items() for j, n in targets.items() if j != key[0])


def test_rewriting_leaves_other_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(100)], "doc_id bigint, text string")
    placed = R.reshard(docs, old_shards=2, shards=2)
    R.rewrite(docs, placed, str(tmp_path / "out"))
    changed = {r.shard for r in R.affected_shards(placed).collect()}
    back = spark.read.parquet(str(tmp_path / "out")).collect() if changed else []
    assert Counter((r.doc_id, r.shard, r.slot) for r in back) == Counter((r.doc_id, r.shard, r.slot) for r in placed.collect() if r.shard in changed)


ODD = [(i, "x" * (i % 37)) for i in range(300)] + [(None, "a"), (None, "a"), (None, None), (3, "xxx"), (3, "other"), (7, "x" * 7), (7, "x" * 7)]


@pytest.mark.parametrize("old, new", [(8, 12), (12, 5), (6, 6)])
def test_rewriting_keeps_every_row(spark, tmp_path, old, new):
    """Null and repeated ids, and columns that clash, through growing, shrinking and evening out."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "out")
    docs = spark.createDataFrame([(i, t, k, str(k)) for k, (i, t) in enumerate(ODD)], "doc_id bigint, text string, slot int, shard string")
    first = R.reshard(docs, old_shards=1, shards=old)
    R.rewrite(docs, first, path)
    assert spark.read.parquet(path).count() == len(ODD)
    by_hash = docs.withColumn("__s", F.pmod(F.xxhash64("doc_id"), F.lit(old)).cast("int"))
    by_hash.withColumnsRenamed({"slot": "own_slot", "shard": "own_shard"}).withColumnRenamed("__s", "shard").withColumn("slot", F.lit(0).cast("bigint")).write.mode("overwrite").partitionBy("shard").parquet(path)
    placed = R.reshard(docs, old_shards=old, shards=new)
    R.rewrite(docs, placed, path)
    back = spark.read.parquet(path)
    assert Counter((r.doc_id, r.text, r.own_slot, r.own_shard) for r in back.collect()) == Counter((i, t, k, str(k)) for k, (i, t) in enumerate(ODD))
    changed = {r.shard for r in R.affected_shards(placed).collect()}
    want = Counter((r.doc_id, r.size, r.shard, r.slot) for r in placed.collect() if r.shard in changed)
    assert Counter((r.doc_id, len(r.text or "") + 16, r.shard, r.slot) for r in back.collect() if r.shard in changed) == want
    assert {r.shard for r in back.select("shard").distinct().collect()} <= set(range(max(old, new)))


def test_the_smallest_rows_of_a_block_move(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(112, 239)) for i in range(2000)]  # sizes of one class
    sides = defaultdict(lambda: ([], []))
    for r in R.reshard(documents(spark, rows), old_shards=4, shards=6, block_rows=25).collect():
        sides[r.old_shard][r.shard != r.old_shard].append(r.size)
    for stay, move in sides.values():
        assert not stay or not move or max(move) <= min(stay) * 33 / 32 + 1
