"""The catalogue's queries as plain SQL, for checking results by value."""

from __future__ import annotations

from hopline.functions.hashing import DRAW_SPAN, HEX_DIGITS
from hopline.operators.kernels import INCREMENT, MULTIPLIERS
from hopline.operators.synth import CATEGORIES, EDGE_TYPES, EMBED_DIM, SEED, TS_BASE, TS_SPAN
from hopline.plans.catalog import (
    CHAIN,
    DIM,
    K,
    LIMIT,
    PART,
    SOURCES,
    START,
    TARGET,
    TARGETS,
    TS_HI,
    TS_LO,
    WARMUP,
)
from hopline.plans.commerce import CODES, ENGINES, ID_SPACE, SIZES, node_id


def _key(category: str, column: str) -> str:
    return f"({CODES[category] * ID_SPACE} + CAST({column} AS BIGINT))"


NODES = f"""n AS (
  SELECT {_key("customer", "c_custkey")} AS id, 'customer' AS category,
         CAST(c_acctbal AS DOUBLE) AS value, CAST(0 AS BIGINT) AS ts FROM customer
  UNION ALL SELECT {_key("order", "o_orderkey")}, 'order', o_totalprice, epoch_ms(o_orderdate) FROM orders
  UNION ALL SELECT {_key("part", "p_partkey")}, 'part', p_retailprice, 0 FROM part
  UNION ALL SELECT {_key("supplier", "s_suppkey")}, 'supplier', s_acctbal, 0 FROM supplier
  UNION ALL SELECT {_key("nation", "n_nationkey")}, 'nation', 0.0, 0 FROM nation
  UNION ALL SELECT {_key("region", "r_regionkey")}, 'region', 0.0, 0 FROM region)"""

EDGES = f"""e AS (
  SELECT {_key("customer", "o_custkey")} AS src, {_key("order", "o_orderkey")} AS dst,
         'placed' AS edge_type, epoch_ms(o_orderdate) AS ts FROM orders
  UNION ALL SELECT {_key("order", "o_orderkey")}, {_key("customer", "o_custkey")}, 'placed_by', epoch_ms(o_orderdate) FROM orders
  UNION ALL SELECT {_key("order", "l_orderkey")}, {_key("part", "l_partkey")}, 'contains', epoch_ms(l_shipdate) FROM lineitem
  UNION ALL SELECT {_key("part", "l_partkey")}, {_key("order", "l_orderkey")}, 'contained_in', epoch_ms(l_shipdate) FROM lineitem
  UNION ALL SELECT {_key("part", "l_partkey")}, {_key("supplier", "l_suppkey")}, 'supplied_by', epoch_ms(l_shipdate) FROM lineitem
  UNION ALL SELECT {_key("customer", "c_custkey")}, {_key("nation", "c_nationkey")}, 'located_in', 0 FROM customer
  UNION ALL SELECT {_key("supplier", "s_suppkey")}, {_key("nation", "s_nationkey")}, 'located_in', 0 FROM supplier
  UNION ALL SELECT {_key("nation", "n_nationkey")}, {_key("region", "n_regionkey")}, 'part_of', 0 FROM nation)"""

GRAPH = f"WITH RECURSIVE {NODES}, {EDGES}"
#: The same for queries without recursion; inlined, so that an outer LIMIT ends early.
PLAIN = f"WITH {NODES}, {EDGES}".replace("n AS (", "n AS NOT MATERIALIZED (").replace(
    "e AS (", "e AS NOT MATERIALIZED ("
)
SLICE = f"{GRAPH}, f AS (SELECT * FROM e WHERE ts BETWEEN {TS_LO} AND {TS_HI})"

LATEST = f"{GRAPH} SELECT src, dst, edge_type, max(ts) AS ts FROM e GROUP BY ALL"

VERSIONS = """v AS (SELECT o_custkey AS id, o_orderstatus AS category, o_totalprice AS value,
                    epoch_ms(o_orderdate) AS ts FROM orders)"""

BARE = """b AS (SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS edge_type,
                       epoch_ms(l_shipdate) AS ts FROM lineitem)"""


def _walks(edges: str, hops: int, pick: str) -> str:
    joins = "".join(f" JOIN {edges} e{i} ON e{i}.src = e{i - 1}.dst" for i in range(2, hops + 1))
    return f"SELECT {pick.format(last=f'e{hops}')} FROM {edges} e1{joins} WHERE e1.src = {START}"


def _levels(roots: list[int]) -> str:
    """Shortest distance of at least one edge from each root, and the roots themselves."""
    return _levels_from("VALUES " + ", ".join(f"({r})" for r in roots))


def _levels_from(roots: str) -> str:
    return f"""{GRAPH},
  roots(root) AS ({roots}),
  s AS (SELECT DISTINCT src, dst FROM e),
  dist(root, node, d) USING KEY (root, node) AS (
    SELECT DISTINCT root, s.dst, 1 FROM roots JOIN s ON s.src = root
    UNION SELECT DISTINCT dist.root, s.dst, dist.d + 1 FROM dist JOIN s ON s.src = dist.node
      WHERE NOT EXISTS (SELECT 1 FROM recurring.dist k WHERE k.root = dist.root AND k.node = s.dst)),
  levels AS (SELECT root, root AS node, 0 AS d FROM roots UNION ALL SELECT root, node, d FROM dist)"""


def _routes(roots: list[int], targets: list[int]) -> str:
    """Routes with the smallest predecessor at every step back from the target."""
    goals = ", ".join(f"({t})" for t in targets)
    return f"""{_levels(roots)},
  goals(target) AS (VALUES {goals}),
  parents AS (
    SELECT v.root, v.node, v.d, min(u.node) AS parent
    FROM dist v JOIN s ON s.dst = v.node
    JOIN levels u ON u.root = v.root AND u.node = s.src AND u.d = v.d - 1 GROUP BY ALL),
  back(source, target, step, node) AS (
    SELECT root, node, d, node FROM dist JOIN goals ON target = node
    UNION ALL
    SELECT source, target, step - 1, parent FROM back
    JOIN parents p ON p.root = source AND p.node = back.node AND p.d = step WHERE step > 0),
  routes AS (SELECT source, target, CAST(step AS BIGINT) AS step, node FROM back)"""


def _chain_levels() -> str:
    return f"""WITH RECURSIVE s AS (
    SELECT CAST(c_custkey AS BIGINT) AS src, CAST(c_custkey AS BIGINT) + 1 AS dst FROM customer
    WHERE c_custkey % {CHAIN} <> {CHAIN - 1}
      AND c_custkey + 1 IN (SELECT c_custkey FROM customer)),
  dist(node, d) USING KEY (node) AS (
    SELECT c_custkey, 0 FROM customer WHERE c_custkey = {CHAIN + 1}
    UNION SELECT s.dst, dist.d + 1 FROM dist JOIN s ON s.src = dist.node
      WHERE NOT EXISTS (SELECT 1 FROM recurring.dist k WHERE k.node = s.dst))"""


def _length(source: int, target: int) -> str:
    return f"""{_levels([source])}
SELECT root AS source, node AS target, CAST(d AS BIGINT) AS length
FROM dist WHERE node = {target}"""


def _matches(category: str) -> str:
    return f"""{GRAPH}, m AS (
  SELECT e1.src AS a, n.id AS b, e2.dst AS c FROM e e1
  JOIN n ON n.id = e1.dst AND n.category = '{category}' JOIN e e2 ON e2.src = n.id)"""


def _triples(category: str, distinct: str = "") -> str:
    return f"{_matches(category)} SELECT {distinct} a, b, c FROM m ORDER BY a, b, c LIMIT {LIMIT}"


def _match_count(category: str) -> str:
    return f"{_matches(category)} SELECT CAST(count(*) AS BIGINT) AS matches FROM m"


def _distance(a: str, b: str) -> str:
    return f"round(list_cosine_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6) + 0.0"


QUERY = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
NEAREST = f"""SELECT vec_id AS id, {_distance("embedding", QUERY)} AS distance
FROM embeddings ORDER BY distance, id LIMIT {K}"""

HYBRID = f"""{GRAPH}, k AS ({NEAREST}),
  h AS (SELECT e.dst FROM e JOIN k ON e.src = {CODES["part"] * ID_SPACE} + k.id)"""

SAMPLES = f"""s AS (
  SELECT 'engine_' || (user_id % 3) AS engine,
         CASE WHEN user_id % 2 = 0 THEN '{SIZES[0]}' ELSE '{SIZES[1]}' END AS size,
         event_type AS query, event_id AS seq, value FROM events)"""


def _stats(by: str) -> str:
    return f"""SELECT {by}, round(min(value), 4) AS min_ms, round(median(value), 4) AS median_ms,
  round(list_sort(list(value))[CAST(floor(0.95 * count(*)) AS BIGINT) + 1], 4) AS p95_ms,
  round(max(value), 4) AS max_ms, count(*) AS iters FROM s GROUP BY {by}"""


SUMMARY = f"WITH {SAMPLES}, m AS ({_stats('engine, size, query')})"


def _ratios(stat: str, threshold: float) -> str:
    return f"""{SUMMARY}, r AS (
  SELECT size, query,
         arg_min(engine, (-{stat}, engine)) AS slowest, arg_min(engine, ({stat}, engine)) AS fastest,
         max({stat}) AS slowest_ms, min({stat}) AS fastest_ms,
         CASE WHEN min({stat}) > 0 THEN max({stat}) / min({stat}) ELSE 0.0 END AS ratio
  FROM m GROUP BY ALL HAVING count(*) >= 2)"""


def _pivot(stat: str) -> str:
    cells = ", ".join(f"max(CASE WHEN engine = '{e}' THEN {stat} END) AS {e}" for e in ENGINES)
    return f"{SUMMARY} SELECT size, query, {cells} FROM m GROUP BY ALL"


def _draw(key: str, stream: str) -> str:
    text = f"md5(concat_ws('|', CAST({key} AS VARCHAR), '{SEED}', {stream}))"
    return f"CAST('0x' || substr({text}, 1, {HEX_DIGITS}) AS BIGINT)"


def _choice(values: list[str], key: str, stream: str) -> str:
    names = ", ".join(f"'{v}'" for v in values)
    return f"[{names}][{_draw(key, stream)} % {len(values)} + 1]"


def _mixed(source: str, column: str, name: str) -> str:
    """CTEs for SplitMix64's output function; products are taken modulo 2^64."""

    def product(x: str, factor: int) -> str:
        return f"CAST((CAST({x} AS UHUGEINT) * {factor}::UHUGEINT) % {2**64}::UHUGEINT AS UBIGINT)"

    first = product(f"xor({column}, {column} >> 30)", MULTIPLIERS[0])
    second = product("xor(m1, m1 >> 27)", MULTIPLIERS[1])
    return f"""{name}1 AS (SELECT *, {first} AS m1 FROM {source}),
  {name}2 AS (SELECT *, {second} AS m2 FROM {name}1),
  {name} AS (SELECT * EXCLUDE (m1, m2, {column}), xor(m2, m2 >> 31) AS {column} FROM {name}2)"""


def _sum64(*terms: str) -> str:
    added = " + ".join(f"CAST({t} AS UHUGEINT)" for t in terms)
    return f"CAST(({added}) % {2**64}::UHUGEINT AS UBIGINT)"


NORMALS = f"""WITH k AS (SELECT c_custkey AS id,
    {_sum64(f"(c_custkey::UHUGEINT * {INCREMENT}::UHUGEINT) % {2**64}::UHUGEINT", str(SEED))} AS x FROM customer),
  {_mixed("k", "x", "start")},
  lanes AS (SELECT id, x, unnest(range(1, {EMBED_DIM} + 1)) AS lane FROM start),
  laned AS (SELECT id, lane,
    {_sum64("x", f"(lane::UHUGEINT * {INCREMENT}::UHUGEINT) % {2**64}::UHUGEINT")} AS x FROM lanes),
  {_mixed("laned", "x", "bits")},
  pairs AS (SELECT id, (lane - 1) // 2 AS pair,
    max(CASE WHEN lane % 2 = 1 THEN CAST(x >> 11 AS DOUBLE) END) AS u,
    max(CASE WHEN lane % 2 = 0 THEN CAST(x >> 11 AS DOUBLE) END) AS v FROM bits GROUP BY ALL),
  polar AS (SELECT id, pair, sqrt(-2.0 * ln((u + 1.0) / {2**53})) AS radius,
    2.0 * pi() * v / {2**53} AS angle FROM pairs)"""

BATCH = f"""WITH p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id, {_distance("c.embedding", "q.embedding")} AS distance
  FROM embeddings q CROSS JOIN embeddings c)
SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
FROM p QUALIFY rank <= {K}"""

ORACLE: dict[str, str] = {
    "ing_01": f"{GRAPH} SELECT * FROM n",
    "ing_02": f"{GRAPH} SELECT * FROM e",
    "ing_03": """WITH x AS (
  SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS position FROM embeddings)
SELECT position, count(*) AS n, round(sum(CAST(x AS DOUBLE)), 6) + 0.0 AS total,
  round(min(CAST(x AS DOUBLE)), 6) AS least, round(max(CAST(x AS DOUBLE)), 6) AS most
FROM x GROUP BY position""",
    "ing_04": f"{GRAPH} SELECT * FROM e",
    "ing_04_clustered": f"{GRAPH} SELECT * FROM e",
    "ing_05": LATEST,
    "ing_05_nodes": f"""WITH {VERSIONS} SELECT id, category, value, ts FROM v
QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, category DESC, value DESC) = 1""",
    "ing_06": f"WITH {VERSIONS} SELECT * FROM v",
    "ing_07": f"""{GRAPH} SELECT src, dst, edge_type, count(*) AS n FROM e GROUP BY ALL
HAVING count(*) > 1""",
    "ing_07_nodes": f"{GRAPH} SELECT id, count(*) AS n FROM n GROUP BY id HAVING count(*) > 1",
    "ing_07_batch": f"""{GRAPH} SELECT src, dst, edge_type, count(*) AS n FROM e GROUP BY ALL
HAVING count(*) > 1 AND count(*) FILTER (ts % 2 <> 0) > 0""",
    "ing_08_batch": f"""{GRAPH}, k AS (SELECT id FROM n WHERE category <> 'supplier'), b AS (SELECT * FROM e WHERE ts % 2 <> 0)
SELECT 'src' AS side, src AS node, count(*) AS n FROM b WHERE src NOT IN (SELECT id FROM k) GROUP BY src
UNION ALL
SELECT 'dst', dst, count(*) FROM b WHERE dst NOT IN (SELECT id FROM k) GROUP BY dst""",
    "ing_08": f"""{GRAPH}, k AS (SELECT id FROM n WHERE category <> 'supplier')
SELECT 'src' AS side, src AS node, count(*) AS n FROM e WHERE src NOT IN (SELECT id FROM k) GROUP BY src
UNION ALL
SELECT 'dst', dst, count(*) FROM e WHERE dst NOT IN (SELECT id FROM k) GROUP BY dst""",
    "ing_08_complete": f"""{GRAPH}
SELECT 'src' AS side, src AS node, count(*) AS n FROM e WHERE src NOT IN (SELECT id FROM n) GROUP BY src
UNION ALL
SELECT 'dst', dst, count(*) FROM e WHERE dst NOT IN (SELECT id FROM n) GROUP BY dst""",
    "ing_04_reopened": f"{GRAPH} SELECT src AS node FROM e WHERE dst = {PART}",
    "ing_05_stored": LATEST,
    "ing_09": LATEST,
    "ing_09_chunks": LATEST,
    "ing_10": f"{SUMMARY} SELECT * FROM m",
    "ing_10_errors": f"""{SUMMARY} SELECT engine, size, query, 'over 350 ms' AS message
FROM m WHERE max_ms > 350""",
    "ing_10_skipped": f"{SUMMARY} SELECT DISTINCT engine, size, 'too small' AS reason FROM m WHERE size = 'small'",
    "ing_10_kinds": f"""{SUMMARY}, a AS (
  SELECT CASE size WHEN 'small' THEN 'vector' ELSE 'graph' END AS kind, engine, avg(median_ms) AS avg_ms, count(*) AS pairs
  FROM m WHERE size IN ('small', 'medium') GROUP BY ALL)
SELECT row_number() OVER (PARTITION BY kind ORDER BY avg_ms, engine) AS place, engine, round(avg_ms, 6) AS avg_ms, pairs, kind
FROM a""",
    "ing_11": f"""{SUMMARY} SELECT engine, size, engine AS db, count(*) AS n_queries
FROM m GROUP BY ALL""",
    "flt_01": f"{GRAPH} SELECT * FROM n WHERE id = {PART}",
    "flt_02": f"{GRAPH} SELECT * FROM e WHERE ts BETWEEN {TS_LO} AND {TS_HI}",
    "flt_03": f"{GRAPH} SELECT * FROM n WHERE category = 'supplier'",
    "flt_04": f"{GRAPH} SELECT src AS a, dst AS b FROM e",
    "flt_05": f"{GRAPH} SELECT DISTINCT src, dst FROM e",
    "flt_06": f"WITH {BARE} SELECT * FROM b WHERE src <> dst",
    "flt_06_loops": f"WITH {BARE} SELECT * FROM b WHERE src = dst",
    "trv_01": f"{GRAPH} SELECT dst AS node FROM e WHERE src = {START}",
    "trv_01_checked": f"""{GRAPH} SELECT dst AS node FROM e
JOIN n ON n.id = e.dst AND n.category <> 'supplier' WHERE src = {PART}""",
    "trv_02": f"{GRAPH} SELECT DISTINCT dst AS node FROM e WHERE src = {PART}",
    "trv_03": f"{PLAIN} {_walks('e', 3, '{last}.dst AS node')}",
    "trv_03_2hop": f"{PLAIN} {_walks('e', 2, '{last}.dst AS node')}",
    "trv_04": f"{GRAPH} {_walks('e', 3, 'count(*) AS walks')}",
    "trv_04_2hop": f"{GRAPH} {_walks('e', 2, 'count(*) AS walks')}",
    "trv_05": f"{GRAPH} {_walks('e', 3, 'count(DISTINCT {last}.dst) AS ends')}",
    "trv_05_2hop": f"{GRAPH} {_walks('e', 2, 'count(DISTINCT {last}.dst) AS ends')}",
    "trv_06": f"""{GRAPH}, r(node, d) AS (
  SELECT {START}, 0 UNION SELECT e.dst, d + 1 FROM r JOIN e ON e.src = node WHERE d < 5)
SELECT node FROM r WHERE d = 5""",
    "trv_07": f"""{_levels([START])}
SELECT node, CAST(min(d) AS BIGINT) AS distance FROM levels GROUP BY node""",
    "tmp_01": f"{SLICE} SELECT * FROM f",
    "tmp_01_by_period": f"{SLICE} SELECT * FROM f",
    "tmp_02": f"{SLICE} {_walks('f', 3, 'count(*) AS walks')}",
    "tmp_02_curve": f"{SLICE} {_walks('f', 3, 'count(*) AS walks')}",
    "tmp_03": f"{SLICE} {_walks('f', 3, 'count(DISTINCT {last}.dst) AS ends')}",
    "tmp_04": f"{SLICE}, g AS (SELECT DISTINCT src, dst FROM f) {_walks('g', 3, 'count(*) AS walks')}",
    "pat_01": _triples("supplier"),
    "pat_01_order": _triples("order"),
    "pat_02": _triples("supplier", "DISTINCT"),
    "pat_02_order": _triples("order", "DISTINCT"),
    "pat_03": _match_count("supplier"),
    "pat_03_order": _match_count("order"),
    "spt_01": _length(START, TARGET),
    "spt_01_long": f"""{_chain_levels()} SELECT CAST({CHAIN + 1} AS BIGINT) AS source,
  CAST(node AS BIGINT) AS target, CAST(d AS BIGINT) AS length FROM dist WHERE node = {2 * CHAIN - 2}""",
    "trv_07_long": f"""{_chain_levels()}
SELECT CAST(node AS BIGINT) AS node, CAST(d AS BIGINT) AS distance FROM dist""",
    "spt_01_cycle": _length(START, START),
    "spt_01_none": _length(node_id("region", 3), START),
    "spt_02": f"{_routes([START], [TARGET])} SELECT * FROM routes",
    "spt_03": f"""{_levels(SOURCES)}
SELECT root AS source, node AS target, CAST(d AS BIGINT) AS length
FROM dist WHERE node IN ({", ".join(str(t) for t in TARGETS)})""",
    "spt_03_routes": f"{_routes(SOURCES, TARGETS)} SELECT * FROM routes",
    "spt_03_categories": f"""{_levels_from("SELECT id FROM n WHERE category = 'supplier'")}
SELECT root AS source, node AS target, CAST(d AS BIGINT) AS length
FROM dist JOIN n ON n.id = node AND n.category = 'region'""",
    "spt_04": f"""{_routes(SOURCES, TARGETS)},
  steps AS (SELECT a.source, a.target, a.step, a.node AS src, b.node AS dst FROM routes a
    JOIN routes b ON a.source = b.source AND a.target = b.target AND b.step = a.step + 1)
SELECT * FROM steps WHERE NOT EXISTS (SELECT 1 FROM e
  WHERE e.src = steps.src AND e.dst = steps.dst AND edge_type <> 'supplied_by')""",
    "spt_04_sound": f"""{_routes([START], [TARGET])},
  steps AS (SELECT a.source, a.target, a.step, a.node AS src, b.node AS dst FROM routes a
    JOIN routes b ON a.source = b.source AND a.target = b.target AND b.step = a.step + 1)
SELECT * FROM steps WHERE NOT EXISTS (SELECT 1 FROM e
  WHERE e.src = steps.src AND e.dst = steps.dst)""",
    "vec_01": f"SELECT vec_id AS id, {_distance('embedding', QUERY)} AS distance FROM embeddings",
    "vec_02": """WITH u AS (SELECT vec_id AS id, embedding,
    sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS len
  FROM embeddings),
  x AS (SELECT id, len, unnest(embedding) AS x, unnest(range(len(embedding))) AS position FROM u)
SELECT id, position, round(CAST(x AS DOUBLE) / len, 6) + 0.0 AS x FROM x""",
    "vec_03": NEAREST,
    "vec_04": """SELECT vec_id AS id, round(list_inner_product(CAST(embedding AS DOUBLE[]),
  CAST((SELECT embedding FROM embeddings WHERE vec_id = 1) AS DOUBLE[])), 6) + 0.0 AS score
FROM embeddings""",
    "vec_05": BATCH,
    "vec_05_radius": BATCH,
    "vec_06": "SELECT vec_id AS id, CAST(1 AS BIGINT) AS cells FROM embeddings",
    "vec_06_reopened": NEAREST,
    "vec_06_appended": NEAREST,
    "vec_07": NEAREST,
    "vec_07_probe": f"""SELECT least(count(*), {K}) AS n_rows, least(count(*), {K}) AS n_ids,
  least(count(*), {K}) AS n_right FROM embeddings""",
    "vec_08_probe": "SELECT count(*) AS n_queries, true AS enough, true AS few FROM embeddings",
    "vec_08": "SELECT vec_id AS query_id, CAST(1.0 AS DOUBLE) AS recall FROM embeddings",
    "hyb_01": f"{HYBRID} SELECT count(DISTINCT dst) AS neighbours FROM h",
    "hyb_02": f"{HYBRID} SELECT count(*) AS neighbours FROM h",
    "agg_01": f"""{GRAPH} SELECT count(*) AS n_rows, count(dst) AS n_ends,
  count(DISTINCT dst) AS n_distinct_ends FROM e""",
    "agg_02": f"WITH {SAMPLES} {_stats('query')}",
    "agg_02_series": f"{SUMMARY} SELECT * FROM m",
    "agg_02_null_series": f"""WITH {SAMPLES.replace("s AS (", "s0 AS (", 1)},
  s AS (SELECT CASE WHEN engine <> 'engine_0' THEN engine END AS engine, query, value FROM s0)
{_stats("engine, query")}""",
    "agg_03": f"""WITH {SAMPLES} SELECT * FROM s
QUALIFY row_number() OVER (PARTITION BY engine, size, query ORDER BY seq) > {WARMUP}""",
    "agg_04": f"""{_ratios("median_ms", 100.0)}
SELECT size, query, slowest, fastest, slowest_ms, fastest_ms, round(ratio, 6) AS ratio,
  ratio > 100.0 AS flagged FROM r""",
    "agg_04_flagged": f"""{_ratios("min_ms", 2.0)}
SELECT size, query, slowest, fastest, slowest_ms, fastest_ms, round(ratio, 6) AS ratio
FROM r WHERE ratio > 2.0""",
    "agg_05": f"""{SUMMARY}, j AS (
  SELECT a.engine, a.size, a.query, a.min_ms AS own, min(b.min_ms) AS lo, max(b.min_ms) AS hi
  FROM m a JOIN m b ON a.size = b.size AND a.query = b.query AND a.engine <> b.engine
  WHERE a.min_ms <> 0 GROUP BY ALL),
  r AS (SELECT engine, size, query, CASE WHEN lo > 0 THEN own / lo ELSE 0.0 END AS slower_by,
    CASE WHEN own > 0 THEN hi / own ELSE 0.0 END AS faster_by FROM j)
SELECT engine, size, query, round(slower_by, 6) AS slower_by, round(faster_by, 6) AS faster_by,
  CASE WHEN slower_by > 2.0 THEN 'slower' WHEN faster_by > 2.0 THEN 'faster' END AS verdict FROM r""",
    "agg_06": f"""{SUMMARY}, a AS (
  SELECT engine, avg(median_ms) AS avg_ms, count(*) AS pairs FROM m
  WHERE size IN ('small', 'medium') GROUP BY engine)
SELECT row_number() OVER (ORDER BY avg_ms, engine) AS place, engine, round(avg_ms, 6) AS avg_ms, pairs
FROM a""",
    "agg_07": _pivot("median_ms"),
    "agg_07_p95": _pivot("p95_ms"),
    "agg_08": f"""WITH {SAMPLES}, l AS (
  SELECT engine, query AS size, CASE WHEN max(value) > 350 THEN 'skipped'
    ELSE CAST(max(value) AS VARCHAR) END AS cell FROM s GROUP BY ALL)
SELECT size, {", ".join(f"coalesce(max(CASE WHEN engine = '{e}' THEN cell END), '—') AS {e}" for e in ENGINES)}
FROM l GROUP BY size""",
    "agg_09": """SELECT lang AS engine, source AS size, CAST(doc_id AS VARCHAR) AS query,
  substr(text, 1, 120) AS message FROM documents""",
    "gen_01": f"""SELECT o_orderkey AS id, {_choice(CATEGORIES, "o_orderkey", "'category'")} AS category,
  {_draw("o_orderkey", "'value'")} / {float(DRAW_SPAN)!r}::DOUBLE AS value,
  {TS_BASE} + {_draw("o_orderkey", "'node_ts'")} % {TS_SPAN} AS ts FROM orders""",
    "gen_02": f"""WITH c AS (SELECT count(*) AS n FROM orders), d AS (
  SELECT event_id, n, {_draw("event_id", "'src'")} % n AS src,
         {_draw("event_id", "'dst'")} % (n - 1) AS step FROM events CROSS JOIN c)
SELECT src, (src + 1 + step) % n AS dst, {_choice(EDGE_TYPES, "event_id", "'edge_type'")} AS edge_type,
  {TS_BASE} + {_draw("event_id", "'edge_ts'")} % {TS_SPAN} AS ts FROM d""",
    "gen_03": f"""{NORMALS}, ends AS (
  SELECT id, max(CASE WHEN pair = 0 THEN radius * cos(angle) END) / sqrt(sum(radius * radius)) AS a,
    max(CASE WHEN pair = {EMBED_DIM // 2 - 1} THEN radius * sin(angle) END) / sqrt(sum(radius * radius)) AS z
  FROM polar GROUP BY id)
SELECT id, CAST({EMBED_DIM} AS BIGINT) AS dim, CAST(1.0 AS DOUBLE) AS norm,
  round(CAST(CAST(a AS FLOAT) AS DOUBLE), 5) + 0.0 AS first,
  round(CAST(CAST(z AS FLOAT) AS DOUBLE), 5) + 0.0 AS last FROM ends""",
    "srt_01": f"""SELECT l_orderkey, l_partkey, l_suppkey,
  round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem
ORDER BY revenue DESC, l_orderkey, l_partkey, l_suppkey LIMIT {LIMIT}""",
    "srt_02": f"{_matches('supplier')} SELECT least(count(*), {LIMIT}) AS n_matches FROM m",
    "scl_01": """WITH t AS (SELECT event_type, epoch_us(ts) // 1000 AS ms FROM events),
  r AS (SELECT event_type, min(ms) AS base, max(ms) - min(ms) AS span FROM t GROUP BY event_type)
SELECT event_type, base + span // 3 AS ts_lo, base + 2 * span // 3 AS ts_hi FROM r""",
    "scl_02": "SELECT event_id, round(value / 7, 4) AS r4, round(value / 7, 2) AS r2 FROM events",
    "scl_03": "SELECT doc_id, 'vec_' || lang AS engine, source AS size FROM documents",
    "scl_04": f"""SELECT vec_id AS id, CAST({DIM} AS BIGINT) AS dim,
  round(list_sum(CAST(embedding AS DOUBLE[])), 5) + 0.0 AS total FROM embeddings""",
    "scl_05": f"""{_levels(SOURCES)}
SELECT root AS source, node AS target, CAST(d AS BIGINT) AS length
FROM dist WHERE node IN ({", ".join(str(t) for t in TARGETS)})""",
}

#: Registered without SQL.
ROWS_ONLY: tuple[str, ...] = ("vec_08_measured",)
