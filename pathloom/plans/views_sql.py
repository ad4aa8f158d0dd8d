"""The views of pathloom.sources.views as common table expressions for DuckDB."""

CORPUS = """corpus AS (
  SELECT path_id, any_value(trim(regexp_extract(file_name, '[^/]*$'), e' \\t\\n\\r')) AS file,
         any_value('0x' || ltrim(regexp_replace(lower(trim(func_addr, e' \\t\\n\\r')), '^0x', ''), '0')) AS func_addr,
         any_value(coalesce(tokens, [])) AS tokens
  FROM paths GROUP BY path_id)"""

TOKENS = CORPUS + """, tok AS (SELECT path_id, file, func_addr, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM corpus)"""

FREQ = TOKENS + """, freq AS (SELECT token, count(*) AS freq FROM tok WHERE token IS NOT NULL GROUP BY token)"""

VOCAB = FREQ + """, voc AS (
  SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, token) + 2 AS INTEGER) AS id, freq FROM freq WHERE freq >= 2 AND token NOT IN ('<PAD>', '<UNK>', '<MASK>')
  UNION ALL SELECT * FROM (VALUES ('<PAD>', 0, 0), ('<UNK>', 1, 0), ('<MASK>', 2, 0)))"""

IDS = VOCAB + """, enc AS (
  SELECT c.path_id, c.file, c.func_addr, c.tokens, coalesce(e.ids, []) AS ids FROM corpus c LEFT JOIN (
    SELECT t.path_id, list(coalesce(v.id, 1) ORDER BY t.pos) AS ids FROM tok t LEFT JOIN voc v ON t.token = v.token GROUP BY t.path_id) e ON c.path_id = e.path_id)"""

#: The width of padded ids: that of the longest path, 500 at most.
WIDTH = "(SELECT CAST(least(coalesce(max(len(ids)), 0), 500) AS BIGINT) FROM enc)"

PADDED = IDS + f""", padded AS (SELECT path_id, list_resize(ids[1:w], w, 0) AS ids, w FROM enc, (SELECT {WIDTH} AS w))"""

GRAPH = """edges AS (
  SELECT DISTINCT func, src, dst FROM (SELECT user_id AS func, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)
  WHERE dst IS NOT NULL AND src <> dst),
nodes AS (SELECT func, src AS node FROM edges UNION SELECT func, dst FROM edges)"""

LOG = """log AS (SELECT CAST(date_diff('day', min(day) OVER (), day) AS INTEGER) AS epoch, loss FROM (SELECT CAST(ts AS DATE) AS day, avg(value) AS loss FROM events GROUP BY 1))"""

VECTORS = """vec AS (SELECT label AS func, vec_id AS path_id, CAST(embedding AS DOUBLE[]) AS emb FROM embeddings)"""
