"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Least node of each connected part; expects link(a, b) and node(id).
COMPONENTS = """
ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
    SELECT id AS a, id AS b FROM node
    UNION
    SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a
),
part AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
"""

OP4 = f"""
WITH RECURSIVE vec AS (
    SELECT vec_id, embedding::DOUBLE[] AS e,
           coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                    AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok
    FROM embeddings
),
node AS (SELECT vec_id AS id FROM vec),
link AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM vec x JOIN vec y ON x.vec_id < y.vec_id AND x.ok AND y.ok
    WHERE list_cosine_similarity(x.e, y.e) >= 0.95
),
{COMPONENTS}
SELECT id AS vec_id, (SELECT count(*) FROM ways WHERE a = id) AS n_links, component_id, id = component_id AS kept
FROM part
"""

OP5 = r"""
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
    FROM documents
),
best AS (
    SELECT h, count(*) AS n, first(doc_id ORDER BY points DESC, doc_id) AS keep FROM t GROUP BY h
)
SELECT doc_id, keep AS keep_id, n AS group_size, doc_id = keep AS kept, h AS text_sha256 FROM t JOIN best USING (h)
"""

OP6 = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
),
pos AS (
    SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS p FROM w
),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 3], chr(10)) AS s FROM pos),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
),
link AS (
    SELECT a, b FROM common JOIN size u ON a = u.doc_id JOIN size v ON b = v.doc_id
    WHERE 100 * c >= 85 * (u.n + v.n - c)
),
node AS (SELECT doc_id AS id FROM documents),
{COMPONENTS}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM part LEFT JOIN size ON id = doc_id
""".replace("\\\\", "\\")

OP7 = f"""
WITH d AS (
    SELECT doc_id, source, len({WORDS}) AS size,
           substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h
    FROM documents
),
per AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
weighed AS (
    SELECT *, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS w,
           3 * source_size AS cap FROM per
),
filled AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, w, source NULLS LAST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY cap / w, w, source NULLS LAST
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed
),
target AS (
    SELECT source, source_size, least(cap, w * (SELECT max(level) FROM filled WHERE level <= cap / w)) AS target
    FROM filled
),
plan AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM target
),
run AS (
    SELECT d.*, p.source_size, p.target, p.base, p.target - p.base * p.source_size AS more,
           coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING
                    AND CURRENT ROW), 0) - sum(size) OVER (PARTITION BY d.source, h) AS before,
           sum(size) OVER (PARTITION BY d.source, h) AS own
    FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
),
edge AS (SELECT *, max(CASE WHEN before <= more THEN h END) OVER (PARTITION BY source) AS cut FROM run)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * least(base + CASE WHEN h < cut OR (h = cut AND more - before > 0 AND 2 * (more - before) >= own)
                                 THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM edge
"""

OP8 = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
sized AS (
    SELECT *, 9 + 7 + 4
        + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
        + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS n
    FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
              FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP9 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (
    SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS p FROM w)
),
least_doc AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (
    SELECT DISTINCT doc_id, p + o AS p
    FROM win JOIN least_doc USING (s), (SELECT unnest(range(0, 13)) AS o) WHERE m < doc_id
),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t
    FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


OP11 = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
           sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
),
drawn AS (
    SELECT doc_id, s, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS one,
           CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS two,
           s = '' OR contains(s, '<P>') OR contains(s, '<S>') OR contains(s, '<M>')
               OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 AS plain,
           CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 AS suffix_first
    FROM t
),
cut AS (
    SELECT *, array_to_string(u[1:least(one, two)], '') AS p,
           array_to_string(u[least(one, two) + 1:greatest(one, two)], '') AS m,
           array_to_string(u[greatest(one, two) + 1:], '') AS rest
    FROM drawn
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
       sha256(CASE WHEN plain THEN s WHEN suffix_first THEN '<S>' || rest || '<P>' || p || '<M>' || m
                   ELSE '<P>' || p || '<S>' || rest || '<M>' || m END) AS output_sha256,
       sha256(s) AS restored_sha256
FROM cut
"""

OP12 = """
WITH vec AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding::DOUBLE[], lambda c: floor(256 * c)) AS x
    FROM embeddings
    WHERE coalesce(len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0, false)
),
scored AS (
    SELECT q.r, q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
    FROM vec q JOIN vec v ON q.r <> v.r AND q.vec_id % 50 = 0
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_itq_dedup": OP4, "op5_exact_dedup": OP5, "op6_jaccard_join": OP6, "op7_source_mix": OP7,
            "op8_chat_format": OP8, "op9_substring_dedup": OP9, "op11_fill_middle": OP11, "op12_topk_search": OP12}
