"""DuckDB SQL for the queries of the ten problems that SQL can express on whole tables.

Not: p4 (DuckDB counts edits in bytes, not tokens), p9 (it has no NFKC), p10, and
the assignments of p2 and p8, of which many are right; what must hold of any is
in p2_whole and p8_rules.
"""

from __future__ import annotations

_CANON = """CASE WHEN u NOT LIKE '%@%' THEN u WHEN u LIKE '<%' AND u LIKE '%>' THEN split_part(u, '@', 1) || '>' ELSE split_part(u, '@', 1) END"""

_TERMS = """
WITH p AS (SELECT path_id, any_value(tokens) AS tokens FROM paths GROUP BY path_id),
n AS (SELECT count(*) AS n FROM p),
t AS (SELECT path_id, unnest(tokens) AS token FROM p),
f AS (SELECT token, count(*) AS occurrences, count(DISTINCT path_id) AS paths FROM t WHERE token IS NOT NULL GROUP BY token)
"""

_RUNS = f"""
WITH e AS (SELECT trace_id, ticks, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS pos FROM traces),
u AS (SELECT trace_id, pos, ticks[pos] AS tick, upper(trim(tok, e' \\t\\n\\r')) AS u FROM e WHERE tok IS NOT NULL),
c AS (SELECT trace_id, pos, tick, {_CANON} AS token FROM u),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY trace_id, token ORDER BY pos) AS run FROM c)
SELECT trace_id, token, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS n_events,
       arg_min(tick, pos) FILTER (WHERE tick IS NOT NULL) AS first_tick,
       arg_max(tick, pos) FILTER (WHERE tick IS NOT NULL) AS last_tick
FROM r GROUP BY trace_id, token, run
"""

_NAME = """regexp_replace(regexp_replace(lower(trim({x}, e' \\t\\n\\r')), '^.*/', '', 's'), '\\.elf$', '')"""

_ALIKE = "nullif(" + _NAME + ", '')"

_GROUPS = f"""
WITH RECURSIVE l AS (
  SELECT {_ALIKE.format(x="name_a")} AS a, {_ALIKE.format(x="name_b")} AS b FROM util_links WHERE name_a IS NOT NULL AND name_b IS NOT NULL),
s AS (SELECT a, b FROM l WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM l WHERE a IS NOT NULL AND b IS NOT NULL),
w AS (SELECT a AS node, a AS seen FROM s UNION SELECT w.node, s.b FROM w JOIN s ON w.seen = s.a),
g AS (SELECT node, min(seen) AS component FROM w GROUP BY node),
r AS (SELECT record_id, CASE WHEN nullif(trim(util, e' \\t\\n\\r'), '') IS NOT NULL THEN {_ALIKE.format(x="util")}
  WHEN contains(label, '_') THEN {_ALIKE.format(x="split_part(label, '_', 1)")} END AS name FROM binary_records)
SELECT r.record_id, coalesce(g.component, r.name) AS group_key FROM r LEFT JOIN g ON r.name = g.node WHERE r.name IS NOT NULL
"""

_PIECES = """
WITH RECURSIVE p AS (SELECT path_id, any_value(tokens) AS tokens FROM paths WHERE len(tokens) > {least} GROUP BY path_id),
b AS (SELECT path_id, len(tokens) AS n,
  list_filter(range(1, len(tokens) + 1), lambda i: starts_with(tokens[i], 'JK_') OR starts_with(tokens[i], '<API_') OR starts_with(tokens[i], '<SYSCALL_')) AS ends FROM p),
f AS (SELECT path_id, n, 1::BIGINT AS start_pos FROM b
  UNION ALL
  SELECT f.path_id, f.n, coalesce(list_max(list_filter(b.ends, lambda e: e BETWEEN f.start_pos + 32 AND f.start_pos + 511)), f.start_pos + 511) - 31
  FROM f JOIN b ON f.path_id IS NOT DISTINCT FROM b.path_id WHERE f.n - f.start_pos + 1 > 512)
SELECT path_id, start_pos, coalesce(lead(start_pos) OVER (PARTITION BY path_id ORDER BY start_pos) + 31, n) AS end_pos FROM f
"""


_NEAR = """
WITH r AS (SELECT record_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM binary_records WHERE record_id IS NOT NULL AND len(embedding) = 256
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT id, list_transform(v, lambda x: x / list_max(list_transform(v, lambda y: abs(y)))) AS v FROM r),
n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM u),
s AS (SELECT a.id AS i, b.id AS j, round(list_dot_product(a.v, b.v) / (a.n * b.n), 12) AS c FROM n a JOIN n b ON a.id <> b.id),
k AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY c DESC, j) AS rank FROM s WHERE c >= 0.8)
SELECT DISTINCT least(i, j) AS record_id_a, greatest(i, j) AS record_id_b FROM k WHERE rank <= 5
"""

#: Every span of 50 tokens of every path with an address, and those that several functions have.
_SPANS = """
WITH p AS (SELECT path_id, any_value(file_name) AS file_name, any_value(func_addr) AS func_addr, any_value(tokens) AS tokens FROM paths GROUP BY path_id),
a AS (SELECT path_id, tokens, coalesce(trim(regexp_extract(file_name, '[^/]*$'), e' \\t\\n\\r'), '') AS shard, regexp_replace(lower(trim(func_addr, e' \\t\\n\\r')), '^0x', '') AS addr FROM p),
o AS (SELECT path_id, tokens, hash(shard, ltrim(addr, '0')) AS owner FROM a WHERE regexp_full_match(addr, '[0-9a-f]+') AND len(tokens) >= 50),
e AS (SELECT path_id, owner, tokens, unnest(range(1, len(tokens) - 48)) AS pos FROM o),
g AS (SELECT path_id, owner, pos, hash(tokens[pos:pos + 49]) AS span FROM e),
m AS (SELECT span FROM g GROUP BY span HAVING min(owner) <> max(owner))
"""


def oracle_sql() -> dict[str, str]:
    pieces = _PIECES.format(least=0)
    return {
        "p1_terms": _TERMS + "SELECT token, occurrences, paths, CASE WHEN paths < 3 THEN 'rare' WHEN paths > 0.8::DOUBLE * (SELECT n FROM n) THEN 'common' END AS mark FROM f",
        "p1_found": _TERMS + "SELECT token FROM f WHERE paths < 3 OR paths > 0.8::DOUBLE * (SELECT n FROM n)",
        "p2_found": _GROUPS,
        "p2_whole": f"SELECT group_key, count(*) AS records, 1 AS splits FROM ({_GROUPS}) GROUP BY group_key",
        "p3_found": _NEAR,
        "p7_found": _SPANS + ", d AS (SELECT DISTINCT span, path_id, owner FROM g SEMI JOIN m USING (span)) SELECT DISTINCT x.path_id AS path_id_a, y.path_id AS path_id_b FROM d x JOIN d y ON x.span = y.span AND x.path_id < y.path_id AND x.owner <> y.owner",
        "p7_share": _SPANS + """, s AS (SELECT path_id, pos FROM g SEMI JOIN m USING (span)),
c AS (SELECT path_id, sum(least(coalesce(step, 50), 50)) AS c FROM (SELECT path_id, lead(pos) OVER (PARTITION BY path_id ORDER BY pos) - pos AS step FROM s) GROUP BY path_id)
SELECT p.path_id, coalesce(len(tokens), 0) AS n_tokens, CAST(coalesce(c.c, 0) AS BIGINT) AS shared_tokens, CASE WHEN len(tokens) > 0 THEN round(coalesce(c.c, 0)::DOUBLE / len(tokens), 6) ELSE 0.0 END AS share FROM p LEFT JOIN c ON p.path_id = c.path_id""",
        "p8_rules": "SELECT count(*) AS texts, 0 AS divided, 0 AS wrong_pieces, 0 AS over_full FROM documents WHERE text <> ''",
        "p5_runs": f"SELECT *, last_tick - first_tick AS duration FROM ({_RUNS})",
        "p5_found": f"SELECT trace_id, start_pos, end_pos FROM ({_RUNS}) WHERE n_events >= 4",
        "p6_pieces": f"SELECT q.*, end_pos - start_pos + 1 AS n_tokens, end_pos < len(tokens) AND (starts_with(tokens[end_pos], 'JK_') OR starts_with(tokens[end_pos], '<API_') OR starts_with(tokens[end_pos], '<SYSCALL_')) AS at_block_end FROM ({pieces}) q JOIN (SELECT path_id, any_value(tokens) AS tokens FROM paths GROUP BY path_id) p USING (path_id)",
        "p6_found": _PIECES.format(least=512),
    }
