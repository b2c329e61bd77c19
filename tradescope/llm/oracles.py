"""DuckDB SQL for the operators that SQL can express, written apart from their Spark code."""

# crc32 of a text of ASCII characters, by the table that its polynomial gives.
_CRC_TABLE = """
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
    FROM (SELECT unnest(range(256)) AS i)
  )
)"""


def _crc32(text: str) -> str:
    """The checksum of an expression, in a query that reads ``crc_table``."""
    letters = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    rounds = f"list_reduce({letters}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)"
    return f"xor({rounds}, 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, leaves: str) -> str:
    """All nodes (level, tree, idx, hash, n) over the rows (tree, idx, hash, n) of ``leaves``."""
    return f"""{name} AS (
  SELECT 0 AS level, tree, idx, hash, n FROM {leaves}
  UNION ALL
  SELECT level + 1, tree, idx // 16, sha256(string_agg(hash, '' ORDER BY idx)), (n + 15) // 16
  FROM {name} WHERE n > 1 GROUP BY level, tree, idx // 16, n
)"""


def _folded(name: str, begin: str, nodes: str) -> str:
    """Rows of ``begin`` (row, tree, idx, proof, hash) carried to the top of their tree."""
    return f"""{name} AS (
  SELECT 0 AS level, row, tree, idx, proof, hash FROM {begin}
  UNION ALL
  SELECT f.level + 1, f.row, f.tree, f.idx // 16,
         f.proof || coalesce(string_agg(s.hash, '' ORDER BY s.idx) FILTER (WHERE s.idx <> f.idx), ''),
         sha256(string_agg(CASE WHEN s.idx = f.idx THEN f.hash ELSE s.hash END, '' ORDER BY s.idx))
  FROM {name} f JOIN {nodes} s ON s.level = f.level AND s.tree = f.tree AND s.idx // 16 = f.idx // 16 AND s.n > 1
  GROUP BY f.level, f.row, f.tree, f.idx, f.proof, f.hash
)"""


MERKLE_SQL = f"""
WITH RECURSIVE {_CRC_TABLE.strip()},
leaves AS (
  SELECT row_number() OVER () AS row, doc_id, source, {_field("source")} AS tree, {_leaf("text")} AS hash,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf(_LOWER)} END AS changed
  FROM documents, crc_table
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash, row) - 1 AS idx,
         count(*) OVER (PARTITION BY tree) AS n
  FROM leaves
),
{_tree("nodes", "numbered")},
subroots AS (
  SELECT t.tree AS name, '' AS tree, t.hash, row_number() OVER (ORDER BY s.source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM nodes t JOIN (SELECT DISTINCT tree, source FROM leaves) s USING (tree) WHERE t.n = 1
),
{_tree("upper_nodes", "subroots")},
{_folded("climbed", "(SELECT row, tree, idx, '' AS proof, coalesce(changed, hash) AS hash FROM numbered)", "nodes")},
handed AS (
  SELECT c.row, '' AS tree, s.idx, c.proof, c.hash
  FROM (SELECT row, arg_max(tree, level) AS name, arg_max(proof, level) AS proof, arg_max(hash, level) AS hash FROM climbed GROUP BY row) c
  JOIN subroots s USING (name)
),
{_folded("finished", "handed", "upper_nodes")},
folded AS (
  SELECT row, arg_max(proof, level) AS proof, arg_max(hash, level) AS folded_root FROM finished GROUP BY row
)
SELECT l.doc_id, l.hash AS leaf, s.hash AS subroot, r.hash AS root, sha256(f.proof) AS proof_sha256, f.folded_root,
       f.folded_root = r.hash AS verified
FROM leaves l JOIN folded f USING (row) JOIN subroots s ON s.name = l.tree, (SELECT hash FROM upper_nodes WHERE n = 1) r
"""

_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

# States: 0 nothing, 1 a system turn, 2 an open user turn, 3 whole pairs.
REPAIR_SQL = f"""
WITH RECURSIVE {_CRC_TABLE.strip()},
given AS (
  SELECT DENSE_RANK() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate
  FROM conversations, crc_table
),
hurt AS (
  SELECT c, conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM given
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) AS time,
         rtrim(text, {_BLANKS}) AS firm
  FROM hurt
),
judged AS (
  SELECT *, CASE WHEN firm = '' THEN 1 WHEN time > 1 THEN 2 WHEN right(firm, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(role) OVER (PARTITION BY c ORDER BY i) AS before
  FROM placed
),
counted AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) AS rows,
         count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY c
),
inserts(q, to_q) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
kept(q, initial, to_q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
-- What may happen at a turn after at most two insertions: more would come back to a state.
ways AS (
  SELECT q, q AS at, 0 AS cost, '' AS letters, '' AS lines FROM (VALUES (0), (1), (2), (3)) v(q)
  UNION ALL SELECT q, to_q, 2, 'I', CASE to_q WHEN 2 THEN 'user:' ELSE 'assistant:' END || chr(10) FROM inserts
  UNION ALL SELECT a.q, b.to_q, 4, 'II', CASE a.to_q WHEN 2 THEN 'user:' ELSE 'assistant:' END || chr(10)
                   || CASE b.to_q WHEN 2 THEN 'user:' ELSE 'assistant:' END || chr(10)
  FROM inserts a JOIN inserts b ON b.q = a.to_q
),
steps AS (
  SELECT j.c, j.i, w.q, w.cost + e.cost AS cost, w.letters || e.letter AS letters, e.to_q, w.lines || e.line AS lines
  FROM judged j, ways w, LATERAL (
    SELECT 3 AS cost, 'D' AS letter, w.at AS to_q, '' AS line
    UNION ALL SELECT 2 + (j.fault = 3)::INT, 'R', n.to_q, CASE n.to_q WHEN 2 THEN 'user:' ELSE 'assistant:' END || j.text || chr(10)
    FROM inserts n WHERE n.q = w.at AND j.fault NOT IN (1, 2)
    UNION ALL SELECT (j.fault = 3)::INT, 'K', k.to_q, j.role || ':' || j.text || chr(10)
    FROM kept k WHERE k.q = w.at AND k.initial = left(j.role, 1) AND j.fault NOT IN (1, 2)
  ) e
),
-- The least (cost, letters) of each state after every turn; the lines go with them.
walk AS (
  SELECT c, 0::BIGINT AS i, 0 AS q, struct_pack(cost := 0, letters := '', lines := '') AS best FROM given GROUP BY c
  UNION ALL
  SELECT w.c, w.i + 1, s.to_q,
         min(struct_pack(cost := w.best.cost + s.cost, letters := w.best.letters || s.letters, lines := w.best.lines || s.lines))
  FROM walk w JOIN steps s ON s.c = w.c AND s.i = w.i + 1 AND s.q = w.q
  GROUP BY w.c, w.i + 1, s.to_q
),
ended AS (
  SELECT w.c, min(struct_pack(cost := w.best.cost + e.cost, letters := w.best.letters || e.letters, lines := w.best.lines || e.lines)) AS best
  FROM walk w JOIN ways e ON e.q = w.q AND e.at IN (0, 3)
  LEFT JOIN counted n ON n.c = w.c
  WHERE w.i = coalesce(n.rows, 0) GROUP BY w.c
)
SELECT g.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate,
       coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, e.best.cost::BIGINT AS cost, e.best.letters AS audit,
       sha256(CASE WHEN e.best.lines = '' THEN '' ELSE left(e.best.lines, length(e.best.lines) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM given) g JOIN ended e USING (c) LEFT JOIN counted n USING (c)
"""
