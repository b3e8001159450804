"""DuckDB SQL for the queries that SQL can express."""

STATEMENTS: dict[str, str] = {}

STATEMENTS["op2_minhash_dedup"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4
        THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i
    FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM pairs JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id
    WHERE 100 * i >= 80 * (p.n + q.n - i)
), reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT r.doc_id, b FROM reached r JOIN links ON r.other = a
), least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

STATEMENTS["op9_decontamination"] = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wide AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS m, unnest(list_transform(
        range(1, greatest(len(w) - 9, 1) + 1),
        lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS s
    FROM b WHERE len(w) > 0
), lengths AS (SELECT DISTINCT m FROM wide),
spans AS (
    SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, lengths WHERE len(w) >= m
), hits AS (
    SELECT doc_id, i, m, item_id FROM spans JOIN wide USING (m)
    WHERE s = array_to_string(w[i:i + m - 1], ' ')
), covered AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM hits) GROUP BY 1
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY 1
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

STATEMENTS["op10_source_mix"] = r"""
WITH RECURSIVE s AS (
    SELECT doc_id, source,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE
            AS weight
    FROM s GROUP BY 1
), total AS (SELECT 1.5 * sum(source_size)::DOUBLE AS t FROM sources),
-- Water level: sources at their cap leave the rest to the others, until none is above.
filled AS (
    SELECT 0 AS step, t / (SELECT sum(weight) FROM sources) AS rate FROM total
    UNION ALL
    SELECT step + 1, (SELECT (t - coalesce(sum(2.0 * source_size)
            FILTER (2.0 * source_size < weight * rate), 0))
            / sum(weight) FILTER (2.0 * source_size >= weight * rate) FROM sources)
    FROM filled, total WHERE step < (SELECT count(*) FROM sources)
), level AS (SELECT max(rate) AS rate FROM filled),
targets AS (
    SELECT source, source_size, round(least(2.0 * source_size, weight * rate), 6) AS target
    FROM sources, level
), grid AS (
    SELECT t, greatest(0, ceil(log2(greatest(1, ceil(floor(t) / 64)))))::INT AS bits FROM total
), ranges AS (
    SELECT source, source_size, target,
        ceil(round(sum(target) OVER w / t * (1 << bits), 3))
        - ceil(round((sum(target) OVER w - target) / t * (1 << bits), 3)) AS slots,
        floor(t)::BIGINT // (1 << bits) + 1 AS block
    FROM targets, grid WINDOW w AS (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING)
), tape AS (
    SELECT source, source_size, target, least(slots * block, round(target))::BIGINT AS reach
    FROM ranges
), placed AS (
    SELECT s.*, source_size, target, reach, coalesce(sum(size) OVER (
        PARTITION BY s.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM s JOIN tape ON s.source IS NOT DISTINCT FROM tape.source
)
SELECT doc_id, size, source_size, target,
    (least(size, greatest(0, reach - start))
     + least(size, greatest(0, reach - start - source_size)))::BIGINT AS taken
FROM placed
"""

STATEMENTS["op11_fill_in_middle"] = r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h,
        regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w FROM documents
), numbers AS (
    SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
        ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn
), cut AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
            OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
            WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
    SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle,
        array_to_string(w[b + 1:], '') AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""

STATEMENTS["op13_source_divergence"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), words AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (
    SELECT lang, term, count(*) AS whole FROM words
    GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM words GROUP BY 1, 2, 3
), langs AS (SELECT lang, count(*) AS v, sum(whole) AS total FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM d),
cells AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.whole
    FROM groups g JOIN kept k USING (lang)
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
    SELECT cells.*, 1 + (1000000000::HUGEINT * (n + 5))
            // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
        1 + (1000000000::HUGEINT * (whole + 5)) // (total + 5 * v) AS q
    FROM cells JOIN langs USING (lang)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY 1, 2, 3
), answers AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
        coalesce(value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q
)
SELECT * FROM (
    SELECT *, row_number() OVER (
        PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM answers)
WHERE part = 'pair' OR rank <= 50
"""
