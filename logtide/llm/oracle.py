"""SQL for DuckDB with the results of those text queries SQL can express."""

from __future__ import annotations

#: Water-filling in closed form: sources in the order in which they reach their
#: caps, and the level that holds if the first of them are clamped.
SOURCE_MIX = r"""
WITH sized AS (
    SELECT doc_id, source,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           md5(concat(coalesce(CAST(doc_id AS VARCHAR), concat('-', md5(coalesce(text, '')))), '/7'))
               AS place
    FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS HUGEINT) AS source_size,
           (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM sized GROUP BY source),
ordered AS (
    SELECT *, sum(source_size) OVER () AS total,
           sum(3 * source_size) OVER by_cap - 3 * source_size AS clamped,
           sum(weight) OVER () - sum(weight) OVER by_cap + weight AS open_weight,
           row_number() OVER by_cap AS place_by_cap
    FROM sources
    WINDOW by_cap AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST
                      ROWS UNBOUNDED PRECEDING)),
level AS (
    SELECT CAST(total - clamped AS HUGEINT) AS num, CAST(open_weight AS HUGEINT) AS den
    FROM ordered WHERE 3 * source_size * open_weight >= (total - clamped) * weight
    ORDER BY place_by_cap LIMIT 1),
targets AS (
    SELECT source, source_size, weight,
           CASE WHEN 3 * source_size * den <= num * weight THEN CAST(3 * source_size AS DOUBLE)
                ELSE CAST(num * weight AS DOUBLE) / CAST(den AS DOUBLE) END AS target,
           CASE WHEN 3 * source_size * den <= num * weight THEN 3
                WHEN source_size = 0 THEN 0
                ELSE (num * weight) // (den * source_size) END AS whole, num, den
    FROM sources CROSS JOIN level),
ranked AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, t.whole,
           2 * t.den * (sum(s.size) OVER so_far) - t.den * s.size AS middle,
           CASE WHEN t.whole >= 3 THEN 0
                ELSE 2 * (t.num * t.weight - t.whole * t.source_size * t.den) END AS rest
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
    WINDOW so_far AS (PARTITION BY s.source ORDER BY s.place ROWS UNBOUNDED PRECEDING))
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END) AS BIGINT)
           AS taken
FROM ranked
"""

TOP_K = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0),
ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
                          AS INTEGER) AS rank, vec_id, score
    FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: Every document beside every bin of every language; for small tables.
QUALITY_RULES = r"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text
    FROM documents),
split AS (
    SELECT rid, doc_id, lang, text,
           regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM docs),
grams AS (
    SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
    FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
twice AS (
    SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
repeated AS (
    SELECT rid, count(DISTINCT i + step) AS n_repeat_words
    FROM twice CROSS JOIN range(3) AS s(step) GROUP BY rid),
counted AS (
    SELECT s.rid, doc_id, lang, len(terms) AS n_terms, length(text) AS n_chars, len(words) AS n_words,
           length(array_to_string(words, '')) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words,
           len(words) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(words) AS base_failed
    FROM split s LEFT JOIN repeated r ON s.rid = r.rid),
classes AS (
    SELECT rid, unnest(list_transform([
        '[^a-z]', '[^A-Z]', '[^0-9]', '[^ ]', '[^\x09-\x0D]', '[^.,;:\x27"()!?-]',
        '[^#$%&*+/<=>@\[\x5C\]^_\x60{|}~]', '[^\x00-\x08\x0E-\x1F\x7F]', '[^\x{80}-\x{2FF}]',
        '[\x00-\x{2FF}]'], lambda p: length(regexp_replace(text, p, '', 'g')))) AS c,
           unnest(range(10)) AS bin
    FROM docs),
per_word AS (
    SELECT rid, term, count(*) AS c FROM (SELECT rid, unnest(terms) AS term FROM split) GROUP BY rid, term),
often AS (
    SELECT lang, term, count(*) AS n
    FROM per_word JOIN counted USING (rid) WHERE n_terms >= 50 GROUP BY lang, term),
sizes AS (
    SELECT lang, count(*) AS size, sum(count(*)) OVER () AS total
    FROM counted WHERE n_terms >= 50 GROUP BY lang),
common AS (
    SELECT lang AS ref, term, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS bin
    FROM often JOIN sizes USING (lang) WHERE size >= 20 AND size * 200 >= total
    QUALIFY bin <= 100),
of_common AS (
    SELECT rid, n_terms, ref, bin, coalesce(c, 0) AS c
    FROM counted CROSS JOIN common LEFT JOIN per_word USING (rid, term)),
bins AS (
    SELECT rid, ref, 1 AS kind, bin, c, n_terms AS n FROM of_common
    UNION ALL
    SELECT rid, ref, 1, 0, n_terms - sum(c), n_terms FROM of_common GROUP BY rid, n_terms, ref
    UNION ALL
    SELECT rid, ref, 0, bin, c, n_chars
    FROM classes JOIN counted USING (rid) CROSS JOIN (SELECT DISTINCT ref FROM common)),
usable AS (
    SELECT rid, lang FROM counted WHERE NOT base_failed AND n_chars >= 200 AND n_terms >= 50),
first_sums AS (
    SELECT ref, kind, bin, sum(c * (1000 * least(n, 1000)) // n) AS value
    FROM bins JOIN usable u ON bins.rid = u.rid AND ref = u.lang GROUP BY ref, kind, bin),
first_refs AS (
    SELECT ref, kind, bin, CAST(value AS DOUBLE) / sum(value) OVER (PARTITION BY ref, kind) AS q FROM first_sums),
first_apart AS (
    SELECT rid, ref, sum(apart) AS apart
    FROM (SELECT b.rid, b.ref, b.kind, greatest(0.0, sum(
                     CASE WHEN c > 0 THEN c / n * log2((c / n) / ((c / n + q) / 2)) ELSE 0 END
                   + CASE WHEN q > 0 THEN q * log2(q / ((c / n + q) / 2)) ELSE 0 END) / 2) AS apart
          FROM bins b JOIN usable u ON b.rid = u.rid AND b.ref = u.lang JOIN first_refs r
               ON b.ref = r.ref AND b.kind = r.kind AND b.bin = r.bin
          GROUP BY b.rid, b.ref, b.kind)
    GROUP BY rid, ref),
ordered AS (
    SELECT rid, ref, floor(1000 * apart) AS step,
           count(*) OVER (PARTITION BY ref ORDER BY floor(1000 * apart)) AS up_to,
           count(*) OVER (PARTITION BY ref) AS n_all
    FROM first_apart),
nearer AS (
    SELECT rid, ref FROM ordered
    QUALIFY step <= min(CASE WHEN 2 * up_to >= n_all THEN step END) OVER (PARTITION BY ref)),
sums AS (
    SELECT b.ref, kind, bin, sum(c * (1000 * least(n, 1000)) // n) AS value
    FROM bins b JOIN nearer u ON b.rid = u.rid AND b.ref = u.ref GROUP BY b.ref, kind, bin),
refs AS (
    SELECT ref, kind, bin, CAST(value AS DOUBLE) / sum(value) OVER (PARTITION BY ref, kind) AS q FROM sums),
apart AS (
    SELECT rid, b.ref, b.kind, any_value(n) AS n, count(*) AS n_bins,
           CASE WHEN any_value(n) = 0 THEN 0.0 ELSE greatest(0.0, sum(
               CASE WHEN c > 0 THEN c / n * log2((c / n) / ((c / n + q) / 2)) ELSE 0 END
             + CASE WHEN q > 0 THEN q * log2(q / ((c / greatest(n, 1) + q) / 2)) ELSE 0 END) / 2) END AS found
    FROM bins b JOIN refs r ON b.ref = r.ref AND b.kind = r.kind AND b.bin = r.bin
    GROUP BY rid, b.ref, b.kind),
distances AS (
    SELECT rid, ref, kind, n, found,
           round(sqrt(greatest(0.0, found - (n_bins - 1) / (8 * ln(2) * greatest(n, 1)))), 6) AS distance
    FROM apart),
nearest AS (
    SELECT w.rid, w.ref, CASE WHEN c.n >= 200 THEN c.distance ELSE 0 END AS class_distance,
           CASE WHEN w.n >= 50 THEN w.distance ELSE 0 END AS word_distance
    FROM distances w JOIN distances c ON w.rid = c.rid AND w.ref = c.ref
    WHERE w.kind = 1 AND c.kind = 0
    QUALIFY row_number() OVER (PARTITION BY w.rid ORDER BY w.found, w.ref) = 1)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(class_distance, 0) <= 0.19 AND coalesce(word_distance, 0) <= 0.25 AS kept,
       ref AS language, coalesce(class_distance, 0) AS class_distance, coalesce(word_distance, 0) AS word_distance
FROM counted LEFT JOIN nearest USING (rid)
"""

#: Every kept term beside every pair of sources; for small tables.
SOURCE_AUDIT = r"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                        'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
words AS (SELECT rid, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (
    SELECT lang, source, term, CAST(coalesce(n, 0) AS HUGEINT) AS n
    FROM groups JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)),
of_group AS (
    SELECT lang, source, term, n,
           1 + 1000000000 * (n + 1) // (sum(n) OVER own + count(*) OVER own) AS p
    FROM cells WINDOW own AS (PARTITION BY lang, source)),
of_lang AS (
    SELECT lang, term, 1 + 1000000000 * (n + 1) // (sum(n) OVER own + count(*) OVER own) AS q
    FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term) WINDOW own AS (PARTITION BY lang)),
pairs AS (
    SELECT g.lang, g.source, h.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // b.p), 0) AS value
    FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN of_group a ON a.lang = g.lang AND a.source = g.source
    LEFT JOIN of_group b ON b.lang = h.lang AND b.source = h.source AND b.term = a.term
    WHERE a.term IS NULL OR b.term IS NOT NULL
    GROUP BY g.lang, g.source, h.source),
found AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q
    FROM of_group JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_source_mix": SOURCE_MIX,
        "op6_top_k": TOP_K,
        "op11_quality_rules": QUALITY_RULES,
        "op13_source_audit": SOURCE_AUDIT,
    }
