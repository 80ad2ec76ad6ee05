import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from walkweave.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<double>, label string, pos int, part int, n int, id int, row int, y int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, 3, 4, 5, 6) for i, v, label in rows], SCHEMA).repartition(3)


def plainly(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The definition, vector by vector, with whole numbers of any size."""
    from fractions import Fraction

    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    dim = len(kept[0][1])
    size = -(-dim // parts)
    same = [[math.floor(Fraction(x) * scale) for x in v] + [0] * (size * parts - dim) for _, v, _ in kept if len(v) == dim]
    cut = [[q[p * size : (p + 1) * size] for p in range(parts)] for q in same]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(near(p, c[p])[1], []).append(c[p])
            for e, held in members.items():
                books[p][e] = [sum(column) // len(held) for column in zip(*held)]
    made = iter([[near(p, c[p]) for p in range(parts)] for c in cut])
    out = []
    for i, v, g in kept:
        found = next(made) if len(v) == dim else None
        out.append([i, None if found is None else "".join(f"{e:02x}" for _, e in found), None if found is None else min(2**63 - 1, sum(min(2**63 - 1, d) for d, _ in found)), g])
    total = {}
    for *_, error, g in out:
        if error is not None:
            total[g] = total.get(g, 0) + error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, error, min(2**63 - 1, total[g]) if g in total else None, sha) for i, code, error, g in out]


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, x if x is not None else 0) for x in r])


def some(n, dim, seed=1, size=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, size) for _ in range(dim)], rng.choice(["a", "b", None])) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        some(120, 16),
        some(40, 13, 2),
        some(30, 3, 3),
        some(5, 8, 4),
        [(i, v, g) for i, v, g in some(60, 16, 5)] + [(1000 + i, [0.25, -0.5] * 8, "hot") for i in range(90)],
        [(i % 4, v, g) for i, v, g in some(50, 8, 6)] + [(None, [0.1] * 8, None)] * 3 + [(3, None, "a"), (4, [0.1, None] * 4, "a"), (5, [math.nan] * 8, "b"), (6, [math.inf] + [0.0] * 7, "b")],
        some(20, 8, 7) + [(2, [1.0] * 5, "odd"), (100, [], "odd"), (101, [1.0], "a")],
        some(20, 16, 8, 1e7) + [(50, [1e300] * 16, "far"), (51, [-1e17 + 3] * 16, "far"), (52, [2.0**40 + 0.3] * 16, None)],
        [(9, [-0.0, 1e-320, -1e-320, 0.0] * 4, "a"), (8, [0.0] * 16, "a"), (7, [-1 / 4096] * 16, "b")],
        [],
        [(1, None, "a")],
    ],
    ids=["plain", "filled", "short", "few", "hot", "odd ids", "odd lengths", "large", "zeros", "empty", "none"],
)
def test_rows_are_those_of_the_definition(spark, rows):
    got, _ = vc.compress(vectors(spark, rows))
    assert in_order(got.collect()) == in_order(plainly(rows))


def test_parameters_and_decoding(spark):
    rows = some(80, 12, 9)
    got, held = vc.compress(vectors(spark, rows), parts=3, entries=5, rounds=2, scale=1 << 10)
    assert in_order(got.collect()) == in_order(plainly(rows, 3, 5, 2, 1 << 10))
    back = {r.vec_id: (r.decoded, r.error) for r in vc.decode(got, held).collect()}
    for i, v, _ in rows:
        decoded, error = back[i]
        exact = [math.floor(x * 1024) for x in v]
        assert sum((a - round(b * 1024)) ** 2 for a, b in zip(exact, decoded)) == error
    with pytest.raises(ValueError):
        vc.compress(vectors(spark, rows), scale=1000)


def test_errors_fall_with_the_rounds(spark):
    rows = vectors(spark, some(300, 16, 10))
    error = [sum(r.error for r in vc.compress(rows, rounds=n)[0].collect()) for n in (0, 1, 6)]
    assert error[0] > error[1] > error[2]


@settings(max_examples=200, deadline=None)
@given(rows=st.lists(st.lists(st.integers(-40000, 40000) | st.integers(-(10**30), 10**30), min_size=3, max_size=3), max_size=8))
def test_packed_rows(rows):
    held = np.array([v for r in rows for v in r], object).reshape(-1, 3)
    packed = vc.pack(held)
    assert [list(map(int, r)) for r in vc.unpack(packed, 3).tolist()] == rows
    assert [p == q for p in packed for q in packed] == [r == s for r in rows for s in rows]
