"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from foldframe.llm.ann import op5_ann
from foldframe.llm.embedding_dedup import op2_embedding_dedup
from foldframe.llm.exact_dedup import op13_exact_dedup
from foldframe.llm.hmm import op4_hmm
from foldframe.llm.lexical import op11_lexical
from foldframe.llm.mixing import op3_mixing
from foldframe.llm.packing import op9_packing
from foldframe.llm.repeats import op6_repeats
from foldframe.llm.runs import op12_runs
from foldframe.llm.secrets import op8_secrets
from foldframe.llm.simhash import op10_simhash
from foldframe.llm.toxicity import op7_toxicity
from foldframe.llm.warc import op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_mixing": op3_mixing,
    "op4_hmm": op4_hmm,
    "op5_ann": op5_ann,
    "op6_repeats": op6_repeats,
    "op7_toxicity": op7_toxicity,
    "op8_secrets": op8_secrets,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_lexical": op11_lexical,
    "op12_runs": op12_runs,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE = {
    "op1_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first, count(*) AS c FROM p WHERE n >= 100 GROUP BY d HAVING count(*) > 1)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (d)
""",
    "op3_mixing": """
WITH b AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM b GROUP BY source),
w AS (SELECT *, place % 3 AS slot, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
             2.0::DOUBLE * n AS cap FROM s),
r AS (SELECT *, cap / w AS ratio, sum(n) OVER () * 1.5::DOUBLE AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                / sum(w) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
v AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1),
t AS (SELECT source, n, slot, least(cap, coalesce((SELECT level FROM v) * w, cap)) AS target FROM l),
a AS (SELECT b.*, t.n, t.slot, t.target,
             coalesce(sum(size) OVER (PARTITION BY b.source ORDER BY h, doc_id, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS u
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - u)) AS t0,
             greatest(0, least(size, floor(target)::BIGINT - u - n)) AS t1,
             CASE WHEN target > 0 THEN u / target ELSE 0.0 END AS x FROM a),
c AS (SELECT *, CASE slot WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS c0,
             CASE slot WHEN 0 THEN 0.625::DOUBLE WHEN 1 THEN 0.375::DOUBLE ELSE 0.5::DOUBLE END AS half,
             CASE slot WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS bend FROM e)
SELECT doc_id, size, n AS source_size, target, (t0 + t1)::BIGINT AS taken,
       CASE WHEN t0 > 0 THEN least(1.0::DOUBLE, CASE
            WHEN x < half THEN 2 * x / (c0 + sqrt(greatest(0.0, c0 * c0 + 2 * bend * x)))
            ELSE 0.5 + 2 * (x - half) / (1.0 + sqrt(greatest(0.0, 1.0 + 2 * bend * (x - half)))) END) END AS position
FROM c
""",
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v
       WHERE label IS NOT NULL AND e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
         AND len([x FOR x IN e IF x <> 0]) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
         AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, least.y)::BIGINT AS component_id,
       vec_id = least(vec_id, least.y) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.x LEFT JOIN least ON vec_id = least.x
""",
    "op6_repeats": """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT r, i, hash(substr(x, 2 * i + 1, 400)) AS k
     FROM (SELECT r, x, unnest(range(0, greatest(0, length(x) // 2 - 199))) AS i FROM d)),
c AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
p AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS j FROM w WHERE k IN (SELECT k FROM c)),
g AS (SELECT r, i, count(*) FILTER (WHERE j IS NULL OR i > j + 200) OVER (PARTITION BY r ORDER BY i) AS span FROM p),
s AS (SELECT r, span, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, span),
t AS (SELECT s.r, a, b, coalesce(lag(b) OVER (PARTITION BY s.r ORDER BY a), 0) AS z FROM s),
u AS (SELECT t.r, sum(b - a)::BIGINT AS removed, count(*)::BIGINT AS spans, max(b) AS last,
             string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM t JOIN d USING (r) GROUP BY t.r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN removed IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN u USING (r)
""",
    "op11_lexical": r"""
WITH pat AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p) AS t FROM documents, pat),
i AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p)) AS term FROM benchmark, pat),
g AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n, sum(len(t))::BIGINT AS l FROM d),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, g GROUP BY term),
m AS (SELECT r, doc_id, (10 + (90 * len(t) * n) // l)::BIGINT AS m FROM d, g WHERE len(t) > 0),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
""",
    "op13_exact_dedup": r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
       regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x FROM documents),
g AS (SELECT doc_id, sha256(x) AS text_sha256, count(*) OVER (PARTITION BY x) AS group_size,
             first_value(doc_id) OVER o AS keep_id, row_number() OVER o AS nth
      FROM d WINDOW o AS (PARTITION BY x ORDER BY length(t) DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, nth = 1 AS kept, text_sha256 FROM g
""",
}
