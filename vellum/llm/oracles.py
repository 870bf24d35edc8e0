"""SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

ORACLES: dict[str, str] = {
    "op4_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND p.payload_bytes >= 100""",
    "op5_near_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWERED}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op6_exact_dedup": f"""WITH d AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g ON g.text_sha256 = d.text_sha256""",
    "op10_mixing": """WITH s AS (SELECT source, sum(strlen(coalesce(text, '')) + 1) AS bytes FROM documents GROUP BY source),
t AS (SELECT sum(bytes) AS all_bytes, sum(pow(CAST(bytes AS DOUBLE), 0.7)) AS all_weight FROM s),
m AS (SELECT source, pow(CAST(bytes AS DOUBLE), 0.7) / all_weight * all_bytes / bytes AS rate FROM s, t),
u AS (SELECT d.doc_id, d.source, m.rate, strlen(coalesce(d.text, '')) AS n_bytes, (CAST('0x' || substr(md5('20:1:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296 AS u FROM documents d JOIN m ON m.source IS NOT DISTINCT FROM d.source),
k AS (SELECT k, CAST(k AS DOUBLE) AS x FROM range(0, 60) r(k)),
c AS (SELECT u.doc_id, u.source, u.rate, u.n_bytes, list_sum(list_transform(range(0, 60), lambda k: CASE WHEN u.u > list_sum(list_transform(range(0, k + 1), lambda i: exp(-u.rate + i * ln(u.rate) - lgamma(i + 1)))) THEN 1 ELSE 0 END)) AS copies FROM u),
x AS (SELECT *, unnest(range(0, CAST(copies AS BIGINT))) AS copy FROM c)
SELECT doc_id, source, copy, copies, round(rate, 6) AS rate, n_bytes, md5('order 20:' || doc_id || ':' || copy) AS shuffle_key FROM x""",
    "op11_hard_negatives": """WITH r AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
w AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM r),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM w a JOIN w b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5""",
    "op12_fill_in_middle": """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
h AS (SELECT *, CAST('0x' || substr(hex, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(hex, 9, 8) AS BIGINT) % (n + 1) AS c2, CAST('0x' || substr(hex, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) AS h4 FROM t),
f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, form, text, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
