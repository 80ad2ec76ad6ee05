"""DuckDB SQL that gives the results of :mod:`.queries` from the same tables."""

from __future__ import annotations

from walkweave.sources.relational import BALANCE, EDGES


def _triples(edges) -> str:
    def node(kind: str | None, key: str) -> str:
        return f"'{kind}:' || CAST({key} AS VARCHAR)" if kind else f"CAST({key} AS VARCHAR)"

    return " UNION ALL ".join(f"SELECT DISTINCT {node(*s)} AS s, '{p}' AS p, {node(*o)} AS o FROM {table}" for p, table, s, o in edges)


T = f"t AS MATERIALIZED ({_triples(EDGES)})"
TB = f"t AS MATERIALIZED ({_triples([*EDGES, BALANCE])})"
FORWARD, BACK = "h AS MATERIALIZED (SELECT s AS v, p, o AS n FROM t)", "h AS MATERIALIZED (SELECT o AS v, p, s AS n FROM t)"
V = "vs AS MATERIALIZED (SELECT s AS v FROM t UNION SELECT o FROM t)"
CUSTOMERS = "SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS entity FROM customer"
ORDERS = "SELECT 'order:' || CAST(o_orderkey AS VARCHAR) AS entity FROM orders"
NATIONS = "SELECT 'nation:' || CAST(n_nationkey AS VARCHAR) AS entity FROM nation"


def walks(roots: str, depth: int, reverse: bool = False, name: str = "w", hops: str = "h") -> str:
    """Common table expressions ``w0`` ... ``w{depth}`` with ``entity, walk, tail``."""
    parts = [f"{name}0 AS (SELECT entity, [entity] AS walk, entity AS tail FROM ({roots}))"]
    for k in range(depth):
        grown = "list_concat([n, p], walk)" if reverse else "list_concat(walk, [p, n])"
        parts.append(f"{name}{k + 1} AS (SELECT entity, CASE WHEN n IS NULL THEN walk ELSE {grown} END AS walk, n AS tail FROM {name}{k} LEFT JOIN {hops} h ON h.v = tail)".replace(" AS (", " AS MATERIALIZED (", 1))
    return ", ".join(parts)


def _bfs(roots: str, depth: int, reverse: bool = False) -> str:
    return f"WITH {T}, {BACK if reverse else FORWARD}, {walks(roots, depth, reverse)} SELECT entity, array_to_string(walk, ' > ') AS walk FROM w{depth}"


_BOTH = f"{T}, {FORWARD}, g AS MATERIALIZED (SELECT o AS v, p, s AS n FROM t), {walks(CUSTOMERS, 1)}, {walks(CUSTOMERS, 1, True, 'r', 'g')}, b AS (SELECT w1.entity, len(r1.walk) - 1 AS root_idx, list_concat(list_slice(r1.walk, 1, len(r1.walk) - 1), w1.walk) AS walk FROM w1 JOIN r1 USING (entity))"


#: The triples after a change.
_CHANGED = f"t2 AS MATERIALIZED (SELECT s, p, o FROM t WHERE p <> 'has_brand' AND NOT (p = 'in_segment' AND o = 'MACHINERY') UNION SELECT DISTINCT o, 'part_of', 'world' FROM t WHERE p = 'in_region' UNION ({_triples([BALANCE])}))"


def _changed_walks(roots: str, depth: int, reverse: bool = False) -> str:
    """Common table expressions of the walks before (``w{depth}``) and after (``u{depth}``) the change."""
    v, n = ("o", "s") if reverse else ("s", "o")
    after = f"h2 AS MATERIALIZED (SELECT {v} AS v, p, {n} AS n FROM t2)"
    return f"WITH {T}, {BACK if reverse else FORWARD}, {_CHANGED}, {after}, {walks(roots, depth, reverse)}, {walks(roots, depth, reverse, 'u', 'h2')}"


def _delta(roots: str, depth: int, reverse: bool = False) -> str:
    a, b = (f"SELECT entity, array_to_string(walk, ' > ') AS walk FROM {x}{depth}" for x in "wu")
    return f"{_changed_walks(roots, depth, reverse)} SELECT 1::INTEGER AS change, * FROM ({b} EXCEPT {a}) UNION ALL SELECT -1::INTEGER AS change, * FROM ({a} EXCEPT {b})"


def _token(x: str) -> str:
    return f"left(md5({x}), 16)"


def _bytes_token(x: str) -> str:
    """The first 8 bytes of the MD5 as Python shows them."""
    pair = f"substr(md5({x}), 2 * i + 1, 2)"
    code = f"CAST('0x' || {pair} AS INTEGER)"
    shown = f"CASE {pair} WHEN '09' THEN '\\t' WHEN '0a' THEN '\\n' WHEN '0d' THEN '\\r' WHEN '5c' THEN '\\\\' ELSE CASE WHEN {code} BETWEEN 32 AND 126 THEN chr({code}) ELSE '\\x' || {pair} END END"
    text = f"list_aggregate(list_transform(range(0, 8), lambda i: {shown}), 'string_agg', '')"
    pairs = f"list_transform(range(0, 8), lambda i: {pair})"
    return f"CASE WHEN list_contains({pairs}, '27') AND NOT list_contains({pairs}, '22') THEN 'b' || chr(34) || {text} || chr(34) ELSE 'b' || chr(39) || replace({text}, chr(39), chr(92) || chr(39)) || chr(39) END"


def _halk(thresholds: tuple[float, ...]) -> str:
    levels = ", ".join(f"({k}, {t})" for k, t in enumerate(thresholds))
    return f"""
WITH {T}, {FORWARD}, {walks(ORDERS, 2)},
w AS MATERIALIZED (SELECT row_number() OVER () AS id, entity, walk FROM w2),
x AS (SELECT id, entity, walk[2 * k] AS p, walk[2 * k + 1] AS n, k FROM (SELECT id, entity, walk, unnest(range(1, len(walk) // 2 + 1)) AS k FROM w)),
f AS (SELECT p, count(DISTINCT id) / (SELECT count(*) FROM w) AS share FROM x GROUP BY p),
l(threshold_idx, least) AS (VALUES {levels}),
y AS (SELECT threshold_idx, id, any_value(entity) AS entity, string_agg(p || ' > ' || n, ' > ' ORDER BY k) AS rest FROM x JOIN f USING (p) JOIN l ON share >= least GROUP BY threshold_idx, id)
SELECT threshold_idx, entity, entity || ' > ' || rest AS walk FROM y
UNION ALL SELECT threshold_idx, entity, entity FROM (SELECT DISTINCT entity FROM w) CROSS JOIN l WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.entity = w.entity AND y.threshold_idx = l.threshold_idx)
""".replace("FROM (SELECT DISTINCT entity FROM w) CROSS JOIN l WHERE", "FROM (SELECT DISTINCT entity FROM w) w CROSS JOIN l WHERE")


def _wl(rounds: int, head: str = "WITH") -> str:
    parts = [T, V, "n0 AS (SELECT v, v AS label FROM vs)", "e0 AS (SELECT s, p, o, p AS label FROM t)"]
    for k in range(rounds):
        came = f"(SELECT o, string_agg(DISTINCT label, '-' ORDER BY label) AS suffix FROM e{k} GROUP BY o)"
        parts.append(f"n{k + 1} AS MATERIALIZED (SELECT v, {_token("label || '-' || coalesce(suffix, '')")} AS label FROM n{k} LEFT JOIN {came} c ON v = o)")
        parts.append(f"e{k + 1} AS MATERIALIZED (SELECT s, p, o, {_token(f"e{k}.label || '-' || n{k}.label")} AS label FROM e{k} JOIN n{k} ON s = v)")
    return f"{head} {', '.join(parts)} SELECT v, label FROM n{rounds}"


def _weights(table: str, on: str, w: str, digits: int = 6, before: str = "") -> str:
    return f"WITH {T}, {FORWARD}{before} SELECT h.v, h.p, h.n, round(CAST({w} AS DOUBLE), {digits}) AS w FROM h LEFT JOIN {table} ON {on}"


def _pagerank(rounds: int, alpha: float = 0.85) -> str:
    parts = [
        V,
        "e AS MATERIALIZED (SELECT DISTINCT s, o FROM t)",
        "d AS MATERIALIZED (SELECT s, count(*) AS out FROM e GROUP BY s)",
        "q AS MATERIALIZED (SELECT v, out, (SELECT count(*) FROM vs) AS n FROM vs LEFT JOIN d ON v = s)",
        "k0 AS MATERIALIZED (SELECT v, out, n, 1.0::DOUBLE / n AS rank FROM q)",
    ]
    for k in range(rounds):
        came = f"(SELECT o, sum(rank / out) AS came FROM e JOIN k{k} ON s = v GROUP BY o)"
        loose = f"(SELECT coalesce(sum(rank), 0) FROM k{k} WHERE out IS NULL)"
        parts.append(f"k{k + 1} AS MATERIALIZED (SELECT v, out, n, {alpha}::DOUBLE * (coalesce(came, 0) + {loose} / n) + (1 - {alpha}::DOUBLE) / n AS rank FROM k{k} LEFT JOIN {came} c ON v = o)")
    return ", " + ", ".join(parts)


_PRED = "f AS MATERIALIZED (SELECT p, CAST(count(*) AS DOUBLE) AS w FROM t GROUP BY p), i AS MATERIALIZED (SELECT o, count(*) AS degree FROM t GROUP BY o), a0 AS (SELECT h.v, h.p, h.n, w FROM h JOIN f USING (p))"


def _chances(inverse: bool, split: bool) -> str:
    first = "max(w) OVER (PARTITION BY v) - (w - min(w) OVER (PARTITION BY v))" if inverse else "w"
    second = "CASE WHEN degree > 0 THEN w / degree ELSE w END" if split else "w"
    return f"""{T}, {FORWARD}, {_PRED}, a1 AS (SELECT v, p, n, {first} AS w FROM a0), a2 AS (SELECT v, p, n, {second} AS w FROM a1 LEFT JOIN i ON n = o),
c AS MATERIALIZED (SELECT v, p, n, CASE WHEN sum(w) OVER (PARTITION BY v) > 0 THEN w / sum(w) OVER (PARTITION BY v) ELSE 1.0 / count(*) OVER (PARTITION BY v) END AS prob FROM a2)"""


def _shares(inverse: bool, split: bool) -> str:
    return f"WITH {_chances(inverse, split)} SELECT v, p, n, round(prob, 6) AS prob FROM c"


#: The number that a generator seeded with 42 gives first.
FIXED_42 = 0.3745401188473625


def _draws(depth: int, walks_each: int, seed: int) -> str:
    """Walks ``w0`` ... of hops drawn by the MD5 of seed, root, walk and level, among shares by the inverse frequency of objects."""
    parts = [
        T,
        FORWARD,
        "f AS MATERIALIZED (SELECT o, CAST(count(*) AS DOUBLE) AS w FROM t GROUP BY o)",
        "a AS (SELECT h.v, h.p, h.n, max(w) OVER (PARTITION BY v) - (w - min(w) OVER (PARTITION BY v)) AS w FROM h JOIN f ON h.n = f.o)",
        "b AS (SELECT v, p, n, CASE WHEN sum(w) OVER (PARTITION BY v) > 0 THEN w / sum(w) OVER (PARTITION BY v) ELSE 1.0 / count(*) OVER (PARTITION BY v) END AS prob FROM a)",
        "c AS MATERIALIZED (SELECT v, p, n, hi - prob AS lo, CASE WHEN row_number() OVER (PARTITION BY v ORDER BY p DESC, n DESC) = 1 THEN 2.0 ELSE hi END AS hi FROM (SELECT *, sum(prob) OVER (PARTITION BY v ORDER BY p, n ROWS UNBOUNDED PRECEDING) AS hi FROM b))",
        f"w0 AS (SELECT entity, number, [entity] AS walk, entity AS tail FROM ({ORDERS}), (SELECT unnest(range(0, {walks_each})) AS number))",
    ]
    for k in range(depth):
        u = f"CAST('0x' || left(md5('{seed}' || chr(9) || entity || chr(9) || CAST(number AS VARCHAR) || chr(9) || '{k}'), 13) AS BIGINT) / 4503599627370496.0"
        parts.append(f"w{k + 1} AS MATERIALIZED (SELECT entity, number, CASE WHEN n IS NULL THEN walk ELSE list_concat(walk, [p, n]) END AS walk, n AS tail FROM (SELECT *, {u} AS u FROM w{k}) LEFT JOIN c ON c.v = tail AND c.lo <= u AND u < c.hi)")
    return f"WITH {', '.join(parts)} SELECT DISTINCT entity, array_to_string(walk, ' > ') AS walk FROM w{depth}"


def _exact(walks_each: int) -> str:
    """Walks of two hops, one after the other, of hops that are not marked: ``m{k}`` are the marks (place, v, p, n) after k walks."""

    def pick(rows: str, of: str, place: int, marks: str) -> str:
        """The hop of each of ``rows`` (entity, tail) that a choice with the fixed number takes among the unmarked ones in order."""
        left = f"SELECT x.entity, h.v, h.p, h.n FROM {rows} x JOIN h ON h.v = x.{of} ANTI JOIN {marks} m ON m.entity = x.entity AND m.place = {place} AND m.v = h.v AND m.p = h.p AND m.n = h.n"
        return f"SELECT entity, v, p, n FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY p, n) - 1 AS k, count(*) OVER (PARTITION BY entity) AS d FROM ({left})) WHERE k = CAST(floor({FIXED_42} * d) AS BIGINT)"

    parts = [T, FORWARD, f"r AS MATERIALIZED ({CUSTOMERS})", "m0 AS MATERIALIZED (SELECT entity, CAST(0 AS INTEGER) AS place, entity AS v, entity AS p, entity AS n FROM r WHERE false)"]
    for k in range(walks_each):
        parts += [
            f"a{k} AS MATERIALIZED ({pick('r', 'entity', 0, f'm{k}')})",
            f"b{k} AS MATERIALIZED ({pick(f'a{k}', 'n', 1, f'm{k}')})",
            f"w{k} AS (SELECT CAST({k} AS INTEGER) AS number, r.entity, CASE WHEN a.n IS NULL THEN r.entity WHEN b.n IS NULL THEN concat_ws(' > ', r.entity, a.p, a.n) ELSE concat_ws(' > ', r.entity, a.p, a.n, b.p, b.n) END AS walk FROM r LEFT JOIN a{k} a USING (entity) LEFT JOIN b{k} b USING (entity))",
            f"m{k + 1} AS MATERIALIZED (SELECT * FROM m{k} UNION ALL SELECT entity, 1, v, p, n FROM b{k} UNION ALL SELECT entity, 0, v, p, n FROM a{k} WHERE entity NOT IN (SELECT entity FROM b{k}))",
        ]
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(walks_each))


_PICKS = f"{_chances(True, False)}, g AS MATERIALIZED (SELECT v, p, n FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY p, n) AS k FROM (SELECT *, sum(prob) OVER (PARTITION BY v ORDER BY p, n ROWS UNBOUNDED PRECEDING) AS cum FROM c) WHERE cum > {FIXED_42} QUALIFY k = 1))"


def _chain(who: str, chains: list[list[str]]) -> str:
    parts = []
    for k, chain in enumerate(chains):
        at = f"(SELECT entity, entity AS node FROM r) c{k}_0"
        for j, p in enumerate(chain):
            at = f"(SELECT DISTINCT entity, o AS node FROM {at} JOIN t ON t.s = node AND t.p = '{p}') c{k}_{j + 1}"
        parts.append(f"SELECT {k} AS chain_idx, r.entity, node FROM r LEFT JOIN {at} USING (entity)")
    return f"""WITH {TB}, r AS MATERIALIZED ({who}), x AS MATERIALIZED ({' UNION ALL '.join(parts)}),
y AS (SELECT *, count(node) OVER (PARTITION BY chain_idx, entity) AS size, try_cast(node AS DOUBLE) AS num FROM x)"""


def _literals(who: str, chains: list[list[str]]) -> str:
    return _chain(who, chains) + " SELECT entity, chain_idx, CASE size WHEN 0 THEN 'none' WHEN 1 THEN 'scalar' ELSE 'tuple' END AS kind, round(num, 6) AS num, CASE WHEN num IS NULL THEN node END AS str FROM y"


def _split() -> str:
    words = r"""CASE WHEN i % 2 = 0 THEN regexp_extract_all(x, '([A-Z][a-z]*|[^A-Z]+)')
  WHEN try_cast(x AS DOUBLE) IS NOT NULL THEN [CAST(CAST(x AS DOUBLE) AS VARCHAR)]
  WHEN len(q) = 1 AND regexp_matches(q[1], '^([A-Za-z]+)([0-9]+)') THEN [regexp_extract(q[1], '^([A-Za-z]+)([0-9]+)', 1), regexp_extract(q[1], '^([A-Za-z]+)([0-9]+)', 2)]
  ELSE q END"""
    return f"""
WITH {T}, {FORWARD}, {walks(ORDERS, 2)}, w AS (SELECT row_number() OVER () AS id, entity, walk FROM w2),
x AS (SELECT id, entity, i, walk[i] AS x, regexp_extract_all(walk[i], '[A-Za-z0-9]+') AS q FROM (SELECT id, entity, walk, unnest(range(1, len(walk) + 1)) AS i FROM w)),
y AS (SELECT id, entity, i, unnest(CASE WHEN i = 1 THEN [x] ELSE list_transform({words}, lambda z: lower(z)) END) AS word, generate_subscripts(CASE WHEN i = 1 THEN [x] ELSE {words} END, 1) AS j FROM x),
z AS (SELECT id, any_value(entity) AS entity, word, min(i * 1000 + j) AS place FROM y GROUP BY id, word),
s AS (SELECT id, any_value(entity) AS entity, string_agg(word, ' > ' ORDER BY place) AS walk FROM z GROUP BY id)
SELECT DISTINCT entity, walk FROM s"""


def _ngrams(who: str, depth: int, wildcards: bool) -> str:
    if wildcards:
        rows = f"SELECT DISTINCT entity, walk FROM (SELECT entity, walk FROM w{depth} UNION ALL SELECT entity, list_transform(walk, lambda x, i: CASE WHEN i = j THEN '*' ELSE x END) FROM (SELECT entity, walk, unnest(range(2, len(walk) + 1)) AS j FROM w{depth}))"
    else:
        rows = f"SELECT DISTINCT entity, walk FROM w{depth}"
    return f"""
WITH {T}, {FORWARD}, {walks(who, depth)}, w AS MATERIALIZED (SELECT row_number() OVER () AS id, entity, walk FROM ({rows})),
x AS (SELECT id, entity, i, walk[i] AS x, CASE WHEN i % 2 = 1 AND i > 3 THEN array_to_string(list_slice(walk, i - 2, i), chr(1)) END AS gram FROM (SELECT id, entity, walk, unnest(range(1, len(walk) + 1)) AS i FROM w)),
d AS (SELECT gram, dense_rank() OVER (ORDER BY gram) - 1 AS number FROM (SELECT DISTINCT gram FROM x WHERE gram IS NOT NULL)),
s AS (SELECT id, any_value(entity) AS entity, string_agg(coalesce(CAST(number AS VARCHAR), x), ' > ' ORDER BY i) AS walk FROM x LEFT JOIN d USING (gram) GROUP BY id)
SELECT DISTINCT entity, walk FROM s"""


def _anonymous(source: str) -> str:
    return f"list_transform({source}, lambda x: CASE WHEN x = entity THEN x ELSE CAST(list_position({source}, x) - 1 AS VARCHAR) END)"


#: What trained vectors must show: customers are closer to those of their nation than to strangers.
_CLOSER = "SELECT 'nation:' || CAST(c_nationkey AS VARCHAR) AS nation, count(*) AS n, CASE WHEN count(*) > 1 THEN true END AS closer FROM customer GROUP BY c_nationkey"

ORACLE_SQL: dict[str, str] = {
    "triples_load": f"WITH {T} SELECT s, p, o FROM t",
    "skip_predicates": f"WITH {T} SELECT s, p, o FROM t WHERE p NOT IN ('has_priority', 'contains')",
    "remove_triples": f"WITH {T} SELECT s, p, o FROM t WHERE NOT (p = 'placed_by' AND regexp_matches(o, '[02468]$'))",
    "hops_fwd": f"WITH {T}, {FORWARD} SELECT v, p, n FROM h",
    "hops_rev": f"WITH {T}, {BACK} SELECT v, p, n FROM h",
    "vertices": f"WITH {T}, {V} SELECT v FROM vs",
    "neighbors": f"WITH {T} SELECT s, p, o FROM t WHERE o = 'nation:3'",
    "exist_check": f"WITH {T}, {V}, r AS ({CUSTOMERS}), q AS (SELECT entity FROM r UNION SELECT entity || 'x' FROM r) SELECT entity, v IS NOT NULL AS \"exists\" FROM q LEFT JOIN vs ON v = entity",
    "bfs_d1": _bfs(ORDERS, 1),
    "bfs_d2": _bfs(CUSTOMERS, 2),
    "bfs_d3": _bfs(ORDERS, 3),
    "bfs_rev_d2": _bfs(NATIONS, 2, True),
    "bfs_with_reverse_d1": f"WITH {_BOTH} SELECT CAST(root_idx AS INTEGER) AS root_idx, entity, array_to_string(walk, ' > ') AS walk FROM b",
    "walk_hash": f"WITH {T}, {FORWARD}, {walks(ORDERS, 2)}, r AS ({ORDERS}) SELECT DISTINCT entity, array_to_string(list_transform(walk, lambda x, i: CASE WHEN i % 2 = 0 OR x LIKE 'order:%' THEN x ELSE {_token('x')} END), ' > ') AS walk FROM w2",
    "anonymous": f"WITH {T}, {FORWARD}, {walks(ORDERS, 2)} SELECT entity, array_to_string({_anonymous('walk')}, ' > ') AS walk FROM w2",
    "walklet": f"WITH {T}, {FORWARD}, {walks(ORDERS, 2)} SELECT DISTINCT entity, entity || ' > ' || x AS walk FROM (SELECT entity, unnest(list_slice(walk, 2, len(walk))) AS x FROM w2) UNION SELECT entity, entity FROM w2 WHERE len(walk) = 1",
    "walklet_reverse": f"WITH {_BOTH} SELECT DISTINCT entity, x || ' > ' || entity AS walk FROM (SELECT entity, walk[i] AS x, i, root_idx FROM (SELECT *, unnest(range(1, len(walk) + 1)) AS i FROM b)) WHERE i <> root_idx + 1 UNION SELECT entity, entity FROM b WHERE len(walk) = 1",
    "ngram_g3": _ngrams(ORDERS, 3, False),
    "ngram_wildcard1": _ngrams(CUSTOMERS, 2, True),
    "split_tokens": _split(),
    "halk_t": _halk((0.1,)),
    "halk_multi_threshold": _halk((0.1, 0.2, 0.9)),
    "wl_1": _wl(1),
    "wl_2": _wl(2),
    "wl_walks": f"{_wl(1).rpartition(' SELECT ')[0]}, {FORWARD}, {walks(CUSTOMERS, 2)} SELECT entity, array_to_string(walk, ' > ') AS walk FROM w2 UNION SELECT entity, string_agg(CASE WHEN i % 2 = 0 OR x LIKE 'customer:%' THEN x ELSE label END, ' > ' ORDER BY i) FROM (SELECT *, walk[i] AS x FROM (SELECT row_number() OVER () AS id, entity, walk, unnest(range(1, len(walk) + 1)) AS i FROM w2)) LEFT JOIN n1 ON v = x GROUP BY walk, entity",
    "w_uniform": f"WITH {T}, {FORWARD} SELECT v, p, n, CAST(1 AS DOUBLE) AS w FROM h",
    "w_objfreq": _weights("(SELECT o, count(*) AS c FROM t GROUP BY o) x", "h.n = x.o", "c"),
    "w_predfreq": _weights("(SELECT p, count(*) AS c FROM t GROUP BY p) x", "h.p = x.p", "c"),
    "w_objpredfreq": _weights("(SELECT p, o, count(*) AS c FROM t GROUP BY p, o) x", "h.n = x.o AND h.p = x.p", "c"),
    "w_wide": _weights("(SELECT s, count(*) AS c FROM t GROUP BY s) x", "h.n = x.s LEFT JOIN (SELECT p, count(*) AS d FROM t GROUP BY p) y ON h.p = y.p", "(1 + coalesce(c, 0)) * (d + 1) / 2.0"),
    "w_pagerank": _weights("k10", "h.n = k10.v", "rank", 9, _pagerank(10)),
    "weights_plain": _shares(False, False),
    "weights_inverse": _shares(True, False),
    "weights_split": _shares(False, True),
    "weights_inverse_split": _shares(True, True),
    "ntriples_roundtrip": f"WITH {T} SELECT s, p, o FROM t",
    "turtle_roundtrip": f"WITH {T} SELECT s, p, o FROM t",
    "add_vertices": f"WITH {T}, {V}, r AS ({CUSTOMERS}) SELECT v FROM vs UNION SELECT entity FROM r UNION SELECT entity || 'x' FROM r",
    "add_edges": f"WITH {TB} SELECT s, p, o FROM t WHERE p NOT IN ('has_priority', 'contains')",
    "entity_gate": "SELECT 'customer:' || CAST(c_custkey AS VARCHAR) || 'x' AS entity FROM customer WHERE c_custkey % 5 = 0",
    "tokens_bytes": f"WITH {T}, {V}, r AS ({NATIONS}) SELECT v, CASE WHEN v IN (SELECT entity FROM r) THEN v ELSE {_bytes_token('v')} END AS label FROM vs",
    "random_walk_bytes": f"WITH {T}, {FORWARD}, {walks(CUSTOMERS, 2)} SELECT DISTINCT entity, array_to_string(list_transform(walk, lambda y, j: CASE WHEN j % 2 = 0 OR y LIKE 'customer:%' THEN y ELSE {_bytes_token('y')} END), ' > ') AS walk FROM w2",
    "dfs_hashed": _draws(3, 4, 7),
    "dfs_exact": _exact(4),
    "dfs_fixed_u": f"WITH {_PICKS}, {walks(ORDERS, 2, hops='g')} SELECT entity, array_to_string(walk, ' > ') AS walk FROM w2",
    "literals_chain1": _literals(CUSTOMERS, [["has_balance"], ["in_segment"], ["has_brand"]]),
    "literals_chain2": _literals(ORDERS, [["placed_by", "has_balance"], ["contains", "has_brand"]]),
    "literals_cast": "WITH x AS (SELECT CAST(c_acctbal AS VARCHAR) AS text FROM customer UNION SELECT c_mktsegment FROM customer UNION SELECT o_orderpriority FROM orders UNION SELECT CAST(p_size AS VARCHAR) FROM part UNION SELECT p_brand FROM part) SELECT text, round(try_cast(text AS DOUBLE), 6) AS num, CASE WHEN try_cast(text AS DOUBLE) IS NULL THEN text END AS str FROM x",
    "literal_features": _chain(CUSTOMERS, [["from_nation"], ["has_balance"]])
    + " SELECT entity, chain_idx, CAST(count(node) AS INTEGER) AS n, count(node) > 0 AS has_any, round(min(num), 6) AS least, round(max(num), 6) AS greatest, round(coalesce(sum(num), 0), 6) AS total, round(avg(num), 6) AS mean, round(stddev_pop(num), 6) AS spread FROM y GROUP BY entity, chain_idx",
    "upsert_walks": f"WITH {T}, {FORWARD}, {walks(CUSTOMERS + ' WHERE c_custkey % 3 <> 0', 1)}, {walks(CUSTOMERS + ' WHERE c_custkey % 2 = 0', 2, name='u')} SELECT entity, array_to_string(walk, ' > ') AS walk FROM w1 WHERE entity NOT IN (SELECT entity FROM u0) UNION ALL SELECT entity, array_to_string(walk, ' > ') FROM u2",
    "walk_delta": _delta(ORDERS, 2),
    "walk_delta_rev": _delta("SELECT s AS entity FROM t UNION SELECT o FROM t", 2, True),
    "kept_walks": f"{_changed_walks(CUSTOMERS, 3)} SELECT entity, array_to_string(walk, ' > ') AS walk FROM u3",
    "w2v_neighbours": _CLOSER,
    "multi_walker": f"WITH {T}, {FORWARD}, {walks(CUSTOMERS, 2)} SELECT DISTINCT 0 AS walker_idx, entity, array_to_string(list_transform(walk, lambda x, i: CASE WHEN i % 2 = 0 OR x LIKE 'customer:%' THEN x ELSE {_token('x')} END), ' > ') AS walk FROM w1 UNION ALL SELECT DISTINCT 1, entity, array_to_string({_anonymous('walk')}, ' > ') FROM w2",
    "fasttext_hash": f"WITH {T}, {V} SELECT v AS name, v AS gram, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, len(v) + 1), lambda i: CAST(ord(v[i]) AS BIGINT))), lambda a, b: ((a - a % 256 + xor(a % 256, b)) % 4000000 * 16777619) % 4000000) % 2000000 AS BIGINT) AS bucket FROM vs",
}
