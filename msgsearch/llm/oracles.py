"""The same results in DuckDB's SQL, for the queries that SQL can express."""

from __future__ import annotations

SPLIT = r"""
d AS (
    SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
        regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w
    FROM documents
)"""

HOST_RULES = (
    "WITH"
    + SPLIT.format(text="coalesce(text, '')")
    + r""",
windows AS (
    SELECT rid, i, array_to_string(w[i:i+7], ' ') AS s
    FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
),
repeated AS (
    SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM windows) WHERE n > 1
),
covered AS (
    SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + 8)) FROM repeated) GROUP BY rid
),
lines AS (
    SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
),
measures AS (
    SELECT d.doc_id, d.source, len(d.w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
    FROM d JOIN lines USING (rid) LEFT JOIN covered USING (rid)
),
judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measures
),
hosts AS (
    SELECT source, count(*)::DOUBLE AS docs, (count(*) FILTER (base_failed))::DOUBLE AS failed FROM judged WHERE source IS NOT NULL GROUP BY source
),
moments AS (
    SELECT sum(failed) AS f, sum(docs) AS n, count(*) - 1 AS others, sum(failed * failed / docs) AS b, sum(docs * docs) AS sq FROM hosts
),
spread AS (
    SELECT m, n - sq / n - others AS room, (b - f * f / n) / (m * (1 - m)) - others AS among
    FROM (SELECT *, least(greatest(f / n, 1e-6), 1 - 1e-6) AS m FROM moments)
),
prior AS (
    SELECT m, CASE WHEN room > 0 AND among > 0 THEN least(greatest(room / among - 1, 1.0), 1000.0) ELSE 1000.0 END AS strength FROM spread
),
bad AS (
    SELECT source FROM hosts, prior WHERE (failed + m * strength) / (docs + strength) > 0.5
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND NOT (source IS NOT NULL AND source IN (SELECT source FROM bad)) AS kept
FROM judged
"""
)

BLOCK_TOPK = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

JACCARD_GROUPS = (
    "WITH RECURSIVE"
    + SPLIT.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """,
shingles AS (
    SELECT DISTINCT rid, array_to_string(w[i:i+3], ' ') AS s
    FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)
),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
common AS (
    SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.rid <> y.rid GROUP BY ALL
),
links AS (
    SELECT a, b FROM common JOIN sizes p ON p.rid = a JOIN sizes q ON q.rid = b WHERE 100 * c >= 85 * (p.n + q.n - c)
),
reach(a, b) AS (SELECT rid, rid FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
components AS (SELECT a AS rid, min(doc_id) AS component_id FROM reach JOIN d ON d.rid = b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN components USING (rid) LEFT JOIN sizes USING (rid)
"""
)

REPEAT_REMOVAL = (
    "WITH"
    + SPLIT.format(text="coalesce(text, '')")
    + """,
windows AS (
    SELECT rid, i, array_to_string(w[i:i+34], ' ') AS s
    FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
),
repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS i FROM repeated),
words AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid),
removed AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN removed USING (rid)
"""
)

DIVERGENCE = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
),
tokens AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
known AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM known GROUP BY ALL),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN known USING (lang, term) GROUP BY ALL),
grp AS (
    SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source)
    GROUP BY ALL
),
probs AS (
    SELECT lang, g.source, term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.total + v) AS p,
        1 + 1000000000 * (k.n + 1) // (s.total + v) AS q
    FROM grp g JOIN sizes s USING (lang) JOIN known k USING (lang) LEFT JOIN counts c USING (lang, source, term)
),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
    FROM probs a JOIN probs b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
every AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
),
above AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM probs WHERE n > 0 AND p > q),
ranked AS (
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM every
    UNION ALL
    SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT FROM above
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

FILL_MIDDLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
        sha256(concat('42:', doc_id)) AS h
    FROM documents
),
draws AS (
    SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
        ('0x' || h[25:32])::BIGINT AS h4
    FROM d
),
cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
            WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM draws
),
parts AS (
    SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:], '') AS s
    FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""
