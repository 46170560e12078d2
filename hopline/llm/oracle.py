"""The queries that SQL can express, for DuckDB."""

from __future__ import annotations

from hopline.llm.chat import SPECIAL
from hopline.llm.common import LOWER, UPPER, WORD
from hopline.llm.url_filter import Rule


def jaccard(percent: int = 80) -> str:
    return f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT reached.doc_id, b FROM reached JOIN links ON a = other)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id FROM s
JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c ON c.doc_id = s.doc_id"""


def chat(hostile: str) -> str:
    marks = f"length(regexp_replace(t, '[^{SPECIAL.pattern[1:]}', '', 'g'))"
    assert SPECIAL.pattern.startswith("[")
    return f"""WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{hostile}'), (-1, 1, 'assistant', '{hostile}')),
f AS (SELECT *, CASE WHEN role = 'assistant' THEN 9 ELSE 14 + length(role) END + length(t) + {marks} AS chars FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""


def _host(url: str) -> str:
    return f"""CASE WHEN strpos({url}, '://') > 0 THEN translate(regexp_extract(
    substr({url}, strpos({url}, '://') + 3), '^[^/?#]*'), '{UPPER}', '{LOWER}') ELSE '' END"""


def _after(url: str, stop: str) -> str:
    return f"""CASE WHEN strpos({url}, '://') > 0 THEN regexp_extract(
    substr({url}, strpos({url}, '://') + 3), '^[^/?#]*([^{stop}]*)', 1) ELSE '' END"""


def url_filter(rules: list[Rule]) -> str:
    listed = ", ".join(f"('{r.name}', '{r.host}', '{r.path}', '{r.verdict}')" for r in rules)
    key = lambda u: f"CASE WHEN {_host(u)} <> '' THEN {_host(u)} || {_after(u, '#')} END"
    fits = "(x.host = r.host OR ends_with(x.host, '.' || r.host)) AND starts_with(x.path, r.path)"
    pick = "arg_max(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule))"
    return f"""WITH RECURSIVE r(rule, host, path, verdict) AS (VALUES {listed}),
p AS (SELECT row_number() OVER () AS i, page_id, coalesce(url, '') AS url, html FROM pages),
u AS (SELECT i, page_id, url, html, {_host("url")} AS host, {_after("url", "?#")} AS path, {key("url")} AS key FROM p),
own AS (SELECT x.i, {pick} AS own FROM u x JOIN r ON {fits} GROUP BY x.i),
m AS (SELECT url, host, path, key, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>', '', 'g') AS h FROM u
  WHERE host <> '' AND regexp_matches(html, '(?i)canonical|refresh')),
t AS (SELECT url, host, path, key, replace(unnest([
    regexp_extract(regexp_extract(h, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), '(?is)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1),
    regexp_extract(regexp_extract(h, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'), '(?is)\\burl\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)
  ]), '&amp;', '&') AS target FROM m),
a AS (SELECT key AS src, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN starts_with(target, '//') THEN regexp_extract(url, '^(.*?)://', 1) || ':' || target
    WHEN starts_with(target, '/') THEN 'x://' || host || target
    WHEN target <> '' THEN 'x://' || CASE WHEN strpos(path, '/') > 0 THEN regexp_extract(host || path, '^(.*/)', 1) ELSE host || '/' END || target
  END AS target FROM t),
e AS (SELECT src, {key("target")} AS dst FROM a),
b AS (SELECT src, dst FROM e WHERE dst IS NOT NULL AND src <> dst UNION SELECT dst, src FROM e WHERE dst IS NOT NULL AND src <> dst),
reached(node, other) AS (SELECT src, src FROM b UNION SELECT node, dst FROM reached JOIN b ON src = other),
n AS (SELECT DISTINCT node, {_host("'x://' || node")} AS host, {_after("'x://' || node", "?#")} AS path FROM reached),
s AS (SELECT x.node, {pick} AS own FROM n x JOIN r ON {fits} GROUP BY x.node),
v AS (SELECT reached.node, bool_or(s.own.verdict = 'block') AND NOT bool_or(s.own.verdict = 'allow') AS blocked
  FROM reached JOIN s ON s.node = reached.other GROUP BY reached.node)
SELECT page_id, u.host, u.path, own.own.rule AS rule,
  coalesce(own.own.verdict, CASE WHEN v.blocked THEN 'block' END, 'allow') AS verdict
FROM u LEFT JOIN own ON own.i = u.i LEFT JOIN v ON v.node = u.key"""


def topk_search(k: int = 20, scale: int = 64) -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""


def conversation_repair() -> str:
    """The cheapest audit row by row: a state is 12 digits of cost, the audit, a bar and the repaired text."""
    space = r"\x20\x09-\x0D"

    def edit(state: str, cost: str, letter: str, line: str | None = None) -> str:
        text = f"substr({state}, strpos({state}, '|') + 1)"
        if line:
            text = f"CASE WHEN {text} = '' THEN '' ELSE {text} || chr(10) END || {line}"
        return f"""CASE WHEN {state} = '~' THEN '~' ELSE printf('%012d', CAST({state}[1:12] AS BIGINT) + {cost}) ||
      {state}[13:strpos({state}, '|') - 1] || '{letter}|' || {text} END"""

    def kept(state: str, initial: str, name: str | None) -> list[str]:
        offers = [f"CASE WHEN w.must OR w.initial <> '{initial}' THEN '~' ELSE {edit(state, 'w.more', 'K', 'w.line')} END"]
        if name:
            line = f"'{name}:' || w.text"
            offers += [f"CASE WHEN w.must THEN '~' ELSE {edit(state, '1 + w.more', 'R', line)} END"]
        return offers

    least = lambda *offers: f"least({', '.join(offers)})"
    gone = lambda state: edit(state, "2", "D")
    user = [offer for s in ("p.a", "p.b", "p.d") for offer in kept(s, "u", "user")]
    insert = lambda state, name: edit(state, "5", "I", f"'{name}:'")
    return f"""WITH RECURSIVE one AS (
  SELECT i, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM one WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM one WHERE k = 8),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
name AS (SELECT DISTINCT name FROM given),
hashed AS (SELECT name, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM name UNION ALL
  SELECT name, i + 1, xor(c >> 8, t[CAST((xor(c, CAST(ascii(substr(name, i + 1, 1)) AS BIGINT)) & 255) + 1 AS INTEGER)])
  FROM hashed, crc WHERE i < length(name)),
code AS (SELECT name, xor(c, 4294967295) % 20 AS code FROM hashed WHERE i = length(name)),
hurt AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM given JOIN code USING (name) WHERE code <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
    NOT regexp_matches(text, '[^{space}]') AS blank, NOT regexp_matches(text, '[.!?][{space}]*$') AS cut_off FROM hurt),
w AS (SELECT conv_id, pos, turn, text, role[1:1] AS initial, role || ':' || text AS line, blank OR seen AS must,
    CASE WHEN cut_off THEN 5 ELSE 0 END AS more, blank, seen AND NOT blank AS duplicate, cut_off AND NOT blank AND NOT seen AS truncated,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1:1] AS pair FROM placed),
c AS (SELECT DISTINCT conv_id FROM conversations),
best(conv_id, pos, a, b, c, d) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '000000000000|', '~', '000000000005I|user:', '000000000010II|user:' || chr(10) || 'assistant:' FROM c
  UNION ALL
  SELECT conv_id, pos, a, b, c, {least("d", insert("c", "assistant"))} FROM (
    SELECT conv_id, pos, a, b, {least("c", *(insert(s, "user") for s in ("a", "b", "d")))} AS c, d FROM (
      SELECT p.conv_id, w.pos, {gone("p.a")} AS a, {least(gone("p.b"), *kept("p.a", "s", None))} AS b,
        {least(gone("p.c"), *user)} AS c, {least(gone("p.d"), *kept("p.c", "a", "assistant"))} AS d
      FROM best p JOIN w ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.pos = p.pos + 1))),
done AS (SELECT conv_id, arg_max(least(a, d), pos) AS v FROM best GROUP BY conv_id),
n AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM w GROUP BY conv_id)
SELECT CAST(done.conv_id AS BIGINT) AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(v[1:12] AS BIGINT) AS cost,
  v[13:strpos(v, '|') - 1] AS audit, sha256(substr(v, strpos(v, '|') + 1)) AS repaired_sha256
FROM done LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM done.conv_id"""
