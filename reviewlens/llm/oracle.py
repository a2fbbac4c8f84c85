"""SQL counterparts of the numbered operators that SQL can express."""

_VECTORS = """
vectors AS (
    SELECT vec_id, {label} AS label,
           list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND {label} IS NOT NULL
      AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)
)"""
_PRODUCT = "CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT)"

EXACT_SEARCH = f"""
WITH {_VECTORS.format(label="0", factor=64)},
scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, {_PRODUCT} AS score
    FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 20 = 0
),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_LABEL = "(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)"
HARD_NEGATIVES = f"""
WITH {_VECTORS.format(label=_LABEL, factor=256)},
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, {_PRODUCT} AS score
    FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
),
ranked AS (
    SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
           CAST(row_number() OVER (
               PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id
           ) AS INTEGER) AS rank
    FROM positives p JOIN scored s USING (anchor_id)
    WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""

SOURCE_AUDIT = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
           coalesce(source, '') AS source
    FROM documents
),
found AS MATERIALIZED (
    SELECT row, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM docs
),
kept AS MATERIALIZED (
    SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT row) >= 30
),
counts AS MATERIALIZED (
    SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL
),
kinds AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
every AS MATERIALIZED (
    SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts USING (lang, source) GROUP BY ALL
),
shares AS MATERIALIZED (
    SELECT e.lang, e.source, k.term, coalesce(n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
    FROM every e JOIN kept k USING (lang) JOIN kinds USING (lang)
    LEFT JOIN counts c ON c.lang = e.lang AND c.source = e.source AND c.term = k.term
),
usual AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) AS q
    FROM counts JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM every GROUP BY lang) USING (lang)
    JOIN kinds USING (lang) GROUP BY lang, term
),
values_of AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
    FROM every a JOIN every b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT x.lang, x.source AS one, y.source AS other, sum(abs(x.p - y.p)) AS value
        FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
        GROUP BY ALL
    ) d ON d.lang = a.lang AND d.one = a.source AND d.other = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM shares JOIN usual USING (lang, term) WHERE n > 0 AND p > q
),
ranked AS (
    SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (
        PARTITION BY lang, source, part ORDER BY value DESC, encode(item)
    )::INTEGER AS rank
    FROM values_of
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = rf"""
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents
),
items AS (
    SELECT item_id, w, least(len(w), 13) AS size FROM (
        SELECT item_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark)
    WHERE len(w) > 0
),
windows AS MATERIALIZED (
    SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
    FROM (SELECT item_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM items)
),
found AS MATERIALIZED (
    SELECT row, i, d.size, item_id
    FROM (SELECT row, size, w, unnest(range(1, len(w) - size + 2)) AS i
          FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size) d
    JOIN windows p ON p.size = d.size AND p.phrase = array_to_string(w[i : i + d.size - 1], ' ')
),
hits AS (
    SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS place FROM found) GROUP BY row
),
matched AS (
    SELECT row, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (row) LEFT JOIN matched USING (row)
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE docs AS MATERIALIZED (
    SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
),
shingles AS MATERIALIZED (
    SELECT DISTINCT row, array_to_string(w[i : i + 4], ' ') AS shingle
    FROM (SELECT row, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
),
sizes AS MATERIALIZED (SELECT row, count(*) AS n FROM shingles GROUP BY row),
shared AS (
    SELECT a.row AS a, b.row AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.row <> b.row
    GROUP BY ALL
),
links AS MATERIALIZED (
    SELECT a, b FROM shared s JOIN sizes x ON x.row = a JOIN sizes y ON y.row = b
    WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)
),
reach AS (
    SELECT row AS a, row AS b FROM docs
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, coalesce(any_value(k), 0) AS n_links, min(o.doc_id) AS component_id
FROM docs d JOIN reach r ON r.a = d.row JOIN docs o ON o.row = r.b LEFT JOIN sizes z ON z.row = d.row
LEFT JOIN (SELECT a, count(*) AS k FROM links GROUP BY a) l ON l.a = d.row
GROUP BY d.row, d.doc_id
"""

ORACLE: dict[str, str] = {
    "op6_decontaminate": DECONTAMINATE,
    "op8_jaccard_join": JACCARD_JOIN,
    "op11_exact_search": EXACT_SEARCH,
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_source_audit": SOURCE_AUDIT,
}
