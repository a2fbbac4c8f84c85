"""The same results in SQL over the same tables, for comparison.

``_PARTS`` holds named subqueries; a query gets those it mentions, in this order.
"""

from __future__ import annotations

import re

_PARTS: dict[str, str] = {}


def _part(name: str, body: str, materialized: bool = False) -> None:
    _PARTS[name] = f"{name} AS {'MATERIALIZED ' if materialized else ''}({body})"


_COMMENTS = r"""
SELECT CAST(substr(d.source, 4) AS BIGINT) AS pid, d.doc_id AS cid, d.text AS content,
       CASE WHEN quality = 1 AND toxic = 0 THEN 5 WHEN quality = 1 THEN 3 ELSE 1 END AS score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""
_part("rated", _COMMENTS)

_part("results", r"""
SELECT conv_id, CAST(floor(turn / 10) AS BIGINT) AS page,
       CAST(row_number() OVER (PARTITION BY conv_id, floor(turn / 10) ORDER BY turn) - 1 AS INTEGER) AS pos,
       text AS content, CAST(turn % 5 + 1 AS INTEGER) AS score
FROM conversations WHERE conv_id % 10 <> 7
""")

_part("sentences", r"""
SELECT pid, cid, sid, trim(s) AS content FROM (
  SELECT pid, cid, unnest(parts) AS s, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS sid
  FROM (SELECT CAST(substr(source, 4) AS BIGINT) AS pid, doc_id AS cid,
               string_split_regex(text, '[.\n]+') AS parts FROM documents))
""")

_part("clauses", r"""
SELECT pid, cid, sid, trim(s) AS content FROM (
  SELECT pid, cid, unnest(parts) AS s, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS sid
  FROM (SELECT CAST(substr(source, 4) AS BIGINT) AS pid, doc_id AS cid,
               string_split_regex(lower(text), '[.\n]+') AS parts
        FROM documents))
WHERE trim(s) <> ''
""", True)

_part("words", r"""
SELECT pid, cid, sid, id, cont,
       CASE (length(cont) + id) % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'a' WHEN 2 THEN 'v' ELSE 'd' END AS pos,
       CASE id % 6 WHEN 0 THEN 'SBV' WHEN 1 THEN 'ADV' WHEN 2 THEN 'HED' WHEN 3 THEN 'ATT'
                   WHEN 4 THEN 'COO' ELSE 'VOB' END AS relate,
       CAST(CASE id % 6 WHEN 0 THEN id + 2 WHEN 1 THEN id + 1 WHEN 2 THEN -1 WHEN 3 THEN id - 1
                        WHEN 4 THEN CASE id % 24 WHEN 4 THEN id - 2 WHEN 10 THEN id - 4
                                                 WHEN 16 THEN id - 8 ELSE id - 16 END
                        ELSE id - 3 END AS INTEGER) AS parent
FROM (SELECT pid, cid, sid, unnest(parts) AS cont,
             CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS id
      FROM (SELECT pid, cid, sid, string_split_regex(content, ' +') AS parts FROM clauses))
""", True)

_part("digest", r"""
SELECT pid AS pId, cid AS cId, sid AS sId, CAST(count(*) AS INTEGER) AS n_words,
       string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id) AS ids,
       string_agg(cont, ' ' ORDER BY id) AS text,
       string_agg(pos, ' ' ORDER BY id) AS pos,
       string_agg(CAST(parent AS VARCHAR), ' ' ORDER BY id) AS parents,
       string_agg(relate, ' ' ORDER BY id) AS relates
FROM words GROUP BY pid, cid, sid
""")

_part("q", "SELECT * FROM words WHERE relate IN ('SBV', 'VOB', 'ATT', 'CMP')")
_part("coo", "SELECT * FROM words WHERE relate = 'COO'")
_part("dependent_side", r"""
SELECT q.pid, q.cid, q.sid, q.id AS wid, m.id AS mid FROM q
JOIN coo m ON m.cid = q.cid AND m.sid = q.sid AND m.parent = q.id
""")
_part("head_side", r"""
SELECT q.pid, q.cid, q.sid, q.id AS wid, m.id AS mid FROM q
JOIN coo m ON m.cid = q.cid AND m.sid = q.sid AND m.parent = q.parent
""")
_part("found", r"""
SELECT pid, cid, sid, id AS wid, 0 AS step, 0 AS mid, 0 AS side, relate, id AS dep, parent AS head, 'base' AS kind FROM q
UNION ALL
SELECT q.pid, q.cid, q.sid, q.id, 1, d.mid, 0, q.relate, d.mid, q.parent, 'dependent'
FROM q JOIN dependent_side d ON d.cid = q.cid AND d.sid = q.sid AND d.wid = q.id
UNION ALL
SELECT q.pid, q.cid, q.sid, q.id, 1, h.mid, 1, q.relate, q.id, h.mid, 'head'
FROM q JOIN head_side h ON h.cid = q.cid AND h.sid = q.sid AND h.wid = q.id
UNION ALL
SELECT q.pid, q.cid, q.sid, q.id, 2, 0, 0, q.relate, d.mid, h.mid, 'cross'
FROM q
JOIN (SELECT cid, sid, wid, max(mid) AS mid FROM dependent_side GROUP BY ALL) d
  ON d.cid = q.cid AND d.sid = q.sid AND d.wid = q.id
JOIN (SELECT cid, sid, wid, max(mid) AS mid FROM head_side GROUP BY ALL) h
  ON h.cid = q.cid AND h.sid = q.sid AND h.wid = q.id
""")
_part("pairs", r"""
SELECT f.pid, f.cid, f.sid, f.relate, f.kind,
       CAST(row_number() OVER (PARTITION BY f.cid, f.sid ORDER BY f.wid, f.step, f.mid, f.side) - 1 AS INTEGER) AS pno,
       d.id AS dep_id, d.cont AS dep, d.pos AS dep_pos, h.id AS head_id, h.cont AS head, h.pos AS head_pos
FROM found f
JOIN words d ON d.cid = f.cid AND d.sid = f.sid AND d.id = f.dep
JOIN words h ON h.cid = f.cid AND h.sid = f.sid AND h.id = f.head
""", True)
_part("flat_pairs", r"""
SELECT pid AS pId, cid AS cId, sid AS sId, pno AS pairNo,
       CASE WHEN relate IN ('ATT', 'SBV') THEN dep_id ELSE head_id END AS first_id,
       CASE WHEN relate IN ('ATT', 'SBV') THEN dep ELSE head END AS "first",
       CASE WHEN relate IN ('ATT', 'SBV') THEN head_id ELSE dep_id END AS second_id,
       CASE WHEN relate IN ('ATT', 'SBV') THEN head ELSE dep END AS "second",
       relate, kind
FROM pairs
""")
_part("sides", r"""
SELECT pid, cid, sid, pno, relate, f, fid, fpos, s, sid_, spos,
       length(f) BETWEEN 2 AND 4 AS fok, length(s) BETWEEN 1 AND 3 AS sok,
       regexp_matches(f, '^(the|ch|au|das)') AS seed
FROM (SELECT pid, cid, sid, pno, relate,
             CASE WHEN relate = 'SBV' THEN dep ELSE head END AS f,
             CASE WHEN relate = 'SBV' THEN dep_id ELSE head_id END AS fid,
             CASE WHEN relate = 'SBV' THEN dep_pos ELSE head_pos END AS fpos,
             CASE WHEN relate = 'SBV' THEN head ELSE dep END AS s,
             CASE WHEN relate = 'SBV' THEN head_id ELSE dep_id END AS sid_,
             CASE WHEN relate = 'SBV' THEN head_pos ELSE dep_pos END AS spos
      FROM pairs)
""")
_part("sizes", "SELECT cid, sid, count(*) AS n FROM words GROUP BY ALL", True)
_part("numbered", r"""
SELECT f.pid, f.cid, f.sid, relate,
       row_number() OVER (PARTITION BY f.cid, f.sid ORDER BY wid, step, mid, side) - 1 AS pno,
       CASE WHEN relate = 'SBV' THEN dep ELSE head END AS fid, CASE WHEN relate = 'SBV' THEN head ELSE dep END AS sid_
FROM found f JOIN sizes z ON z.cid = f.cid AND z.sid = f.sid WHERE head >= 0 AND head < n
""")
_part("short", "SELECT cid, sid, id, cont, pos FROM words WHERE length(cont) BETWEEN 1 AND 4", True)
_part("short_sides", r"""
SELECT n.pid, n.cid, n.sid, CAST(pno AS INTEGER) AS pno, relate, f.cont AS f, fid, f.pos AS fpos, s.cont AS s, sid_,
       s.pos AS spos, regexp_matches(f.cont, '^(the|ch|au|das)') AS seed
FROM numbered n
JOIN short f ON f.cid = n.cid AND f.sid = n.sid AND f.id = fid
JOIN short s ON s.cid = n.cid AND s.sid = n.sid AND s.id = sid_
WHERE length(f.cont) >= 2 AND length(s.cont) <= 3
""", True)
_part("edges", r"""
SELECT pid, f, fpos, s, spos, seed, count(*) AS n FROM short_sides GROUP BY ALL
""", True)
_part("reach", r"""
SELECT DISTINCT pid, 's' AS side, s AS word, 0 AS t FROM edges WHERE seed AND spos = 'a'
UNION
SELECT DISTINCT e.pid, CASE WHEN r.side = 's' THEN 'f' ELSE 's' END,
       CASE WHEN r.side = 's' THEN e.f ELSE e.s END, r.t + 1
FROM reach r JOIN edges e
  ON e.pid = r.pid AND NOT e.seed
 AND ((r.side = 's' AND e.s = r.word AND e.fpos IN ('n', 'v')) OR (r.side = 'f' AND e.f = r.word AND e.spos = 'a'))
WHERE NOT EXISTS (
  SELECT 1 FROM recurring.reach k
  WHERE k.pid = e.pid AND k.side = CASE WHEN r.side = 's' THEN 'f' ELSE 's' END
    AND k.word = CASE WHEN r.side = 's' THEN e.f ELSE e.s END)
""")
_PARTS["reach"] = _PARTS["reach"].replace("reach AS (", "reach(pid, side, word, t) USING KEY (pid, side, word) AS (", 1)
_part("by_edge", r"""
SELECT e.*, CASE WHEN e.seed OR (ts.t IS NULL AND tf.t IS NULL) THEN NULL
                 WHEN coalesce(ts.t, 1000000) < coalesce(tf.t, 1000000) THEN 's' ELSE 'f' END AS by_side
FROM edges e
LEFT JOIN reach ts ON ts.pid = e.pid AND ts.side = 's' AND ts.word = e.s
LEFT JOIN reach tf ON tf.pid = e.pid AND tf.side = 'f' AND tf.word = e.f
""")
_part("labelled", r"""
SELECT *, CASE WHEN seed THEN CASE WHEN spos = 'a' THEN -1 ELSE 1 END
               WHEN by_side = 's' THEN CASE WHEN fpos IN ('n', 'v') THEN -1 ELSE 1 END
               WHEN by_side = 'f' THEN CASE WHEN spos = 'a' THEN -1 ELSE 1 END
               ELSE 0 END AS label
FROM by_edge
""", True)
_part("marked", r"""
SELECT p.*, CASE WHEN NOT (fok AND sok) THEN 1 ELSE l.label END AS label
FROM sides p LEFT JOIN labelled l
  ON p.fok AND p.sok AND l.pid = p.pid AND l.f = p.f AND l.fpos = p.fpos AND l.s = p.s AND l.spos = p.spos
""")
_part("accepted", r"""
SELECT p.*, l.label FROM short_sides p JOIN labelled l
  ON l.pid = p.pid AND l.f = p.f AND l.fpos = p.fpos AND l.s = p.s AND l.spos = p.spos AND l.label = -1
""", True)
_part("learned", r"""
SELECT pid, f AS name, sum(CASE WHEN by_side = 'f' OR label = -1 THEN n END) AS freq
FROM labelled WHERE NOT seed GROUP BY pid, f
""")
_part("features", r"""
SELECT pid, f AS name, count(*) AS freq FROM sides WHERE fok AND seed GROUP BY pid, f
UNION ALL SELECT pid, name, CAST(freq AS BIGINT) FROM learned WHERE freq > 3
""")

_part("adverbs", r"""
SELECT cid, sid, id, parent, cont FROM words WHERE relate = 'ADV' AND regexp_matches(cont, 'un|no|de|th')
""", True)
_part("negs", r"""
SELECT a.cid, a.sid, a.pno, count(*) AS hits, arg_max(w.cont, w.id) AS neg_word, max(w.id) AS neg_id
FROM accepted a JOIN adverbs w
  ON w.cid = a.cid AND w.sid = a.sid AND w.parent = a.sid_ AND w.id > a.fid AND w.id < a.sid_
GROUP BY ALL
""", True)
_part("with_negs", r"""
SELECT a.*, CASE WHEN hits % 2 = 1 THEN neg_id END AS neg_id, CASE WHEN hits % 2 = 1 THEN neg_word END AS neg_word
FROM accepted a LEFT JOIN negs n ON n.cid = a.cid AND n.sid = a.sid AND n.pno = a.pno
""")
_part("openings", r"""
SELECT cid, sid FROM words WHERE id = 0 AND pos IN ('c', 'd') AND regexp_matches(cont, 'die|the|la|es')
""", True)
_part("resets", r"""
SELECT a.cid, max(a.sid) AS last FROM accepted a JOIN openings w ON w.cid = a.cid AND w.sid = a.sid GROUP BY a.cid
""", True)
_part("tuples", r"""
SELECT n.* FROM with_negs n LEFT JOIN resets r ON r.cid = n.cid WHERE n.sid >= coalesce(r.last, n.sid)
""")
_part("vocabulary", "SELECT DISTINCT s AS word FROM short_sides")
_part("lexicon", r"""
SELECT word, CASE WHEN contains(word, 'a') THEN -1 ELSE 1 END AS polarity
FROM vocabulary WHERE contains(word, 'a') OR contains(word, 'e')
""")
_part("polarity", r"""
SELECT v.word, CAST(coalesce(l.polarity, g.polarity) AS INTEGER) AS polarity
FROM vocabulary v LEFT JOIN lexicon l ON l.word = v.word
LEFT JOIN (SELECT substr(md5(word), 1, 3) AS grp, arg_min(polarity, word) AS polarity FROM lexicon GROUP BY ALL) g
  ON g.grp = substr(md5(v.word), 1, 3)
WHERE l.polarity IS NOT NULL OR g.polarity IS NOT NULL
""")
_part("degrees", r"""
SELECT t.*, CAST(coalesce(p.polarity, 0) * CASE WHEN neg_word IS NULL THEN 1 ELSE -1 END AS INTEGER) AS deg_value
FROM tuples t LEFT JOIN polarity p ON p.word = t.s
""", True)
_part("comment_degrees", r"""
SELECT pid, cid, sum(deg_value) / count(*) AS degree FROM degrees GROUP BY pid, cid
""")
_part("shown", r"""
SELECT pid, cid, f, coalesce(neg_word, '') || s AS word, deg_value > 0 AS good
FROM degrees WHERE deg_value <> 0
""", True)
_part("top_words", r"""
SELECT pid, f, good, word FROM (
  SELECT pid, f, good, word, row_number() OVER (PARTITION BY pid, f, good ORDER BY n DESC, word) AS rn
  FROM (SELECT pid, f, good, word, count(*) AS n FROM shown GROUP BY ALL))
WHERE rn = 1
""")
_part("tags", r"""
SELECT a.pid AS pId, a.f AS tFeature, w.word AS tSentiment,
       CASE WHEN good_count / total >= 0.5 THEN good_count / total ELSE 1 - good_count / total END AS tRate,
       good_count / total >= 0.5 AS tIsPos, total AS tCount, tCommentCount, freq
FROM (SELECT pid, f, count(*) AS total, count(*) FILTER (good) AS good_count, count(DISTINCT cid) AS tCommentCount
      FROM shown GROUP BY ALL) a
JOIN features v ON v.pid = a.pid AND v.name = a.f
JOIN top_words w ON w.pid = a.pid AND w.f = a.f AND w.good = (good_count / total >= 0.5)
""", True)
_part("hot", r"""
SELECT * EXCLUDE (mean) FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY pId, tIsPos ORDER BY tRate DESC, freq DESC, tFeature) AS INTEGER) AS "rank"
  FROM (SELECT *, avg(tCount) OVER (PARTITION BY pId, tIsPos) AS mean FROM tags) WHERE tCount > mean)
WHERE "rank" <= 100
""")
_part("totals", r"""
SELECT pid AS pId, count(*) AS identifiedCount, count(*) FILTER (degree > 0.5) AS goodCount,
       count(*) FILTER (degree > 0.5) / count(*) AS goodRate
FROM comment_degrees GROUP BY pid
""")

_part("lines", r"""
SELECT CAST(score AS VARCHAR) || chr(9) || regexp_replace(trim(content), '[\r\n]+', ' ', 'g') AS value FROM rated
""")
_part("rated_text", r"""
SELECT DISTINCT CAST(f[1] AS INTEGER) AS rating, f[2] AS text
FROM (SELECT string_split(value, chr(9)) AS f FROM lines) WHERE len(f) = 2
""")
_part("tokens", r"SELECT cid, regexp_extract_all(content, '[\p{L}\p{N}]+') AS tokens FROM rated")
_part("counts", r"""
SELECT word, count(*) AS n FROM (SELECT unnest(tokens) AS word FROM tokens) GROUP BY word
""")
_part("stops", "SELECT word, n FROM counts ORDER BY n DESC, word LIMIT 10")

_part("cache", r"""
SELECT page_id, url, html, CASE WHEN page_id % 5 = 0 THEN 503 ELSE 200 END AS code,
       TIMESTAMP '2024-01-01' + to_hours(page_id) AS fetched_at FROM pages
UNION ALL
SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN '' ELSE html END, 200,
       TIMESTAMP '2024-01-01' + to_hours(page_id + 7) FROM pages WHERE page_id % 3 = 0
""")
_part("latest", r"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC) AS rn
  FROM cache WHERE fetched_at >= TIMESTAMP '2024-02-01' - INTERVAL 30 DAY)
WHERE rn = 1
""")

_part("ratios", r"""
SELECT *, 1 - len(list_distinct(parts)) / len(parts) AS ratio FROM (
  SELECT *, string_split(coalesce(array_to_string(regexp_extract_all(content, '[\p{L}\p{N}]+'), '/'), ''), '/') AS parts
  FROM sentences)
""")
_URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
_part("purged", f"""
SELECT pid AS pId, cid AS cId, sid AS sId, content FROM ratios
WHERE length(content) BETWEEN 4 AND 100 AND NOT regexp_matches(content, '{_URL}') AND NOT ratio > 0.5
""")

_part("balanced_text", """
SELECT text, 0 AS label FROM rated_text WHERE rating < 4
UNION ALL
SELECT text, 1 FROM (
  SELECT text, row_number() OVER (ORDER BY md5(text), text) AS rn FROM rated_text WHERE rating = 5)
WHERE rn <= (SELECT count(*) FROM rated_text WHERE rating < 4)
""", True)
_part("bayes_tokens", r"""
SELECT *, ('0x' || substr(md5(text), 1, 4))::INTEGER % 100 < 60 AS training FROM (
  SELECT row_number() OVER () AS row, text, label, regexp_extract_all(text, '[\p{L}\p{N}]+') AS tokens FROM balanced_text)
""", True)
_part("bayes_words", """
SELECT * FROM (SELECT row, label, training, unnest(tokens) AS word FROM bayes_tokens)
WHERE word NOT IN (
  SELECT word FROM (SELECT unnest(tokens) AS word FROM bayes_tokens) GROUP BY word ORDER BY count(*) DESC, word LIMIT 10)
""", True)
_part("bayes_counts", """
SELECT word, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1
FROM bayes_words WHERE training GROUP BY word
""", True)
_part("bayes_model", """
SELECT word, ln((n0 + 1) / (t0 + v)) AS negative, ln((n1 + 1) / (t1 + v)) AS positive
FROM bayes_counts, (SELECT sum(n0) AS t0, sum(n1) AS t1, count(*) AS v FROM bayes_counts)
""", True)

_PAIR = 'SELECT pId, cId, sId, pairNo, first_id, "first", second_id, "second", relate{more} FROM flat_pairs'
_OPINION = "pid AS pId, cid AS cId, sid AS sId, pno AS pairNo, f AS feature, s AS sentiment, relate"
_RESULT = "SELECT conv_id, page, pos, {content} AS content, score FROM results"

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_WRITTEN = "".join(chr(0x4E00 + i) for i in range(26)) * 2
_part(
    "text_runs",
    rf"""SELECT run, count(*) AS n FROM (
        SELECT unnest(regexp_extract_all(translate(replace(text, ' ', ''), '{_LETTERS + _LETTERS.upper()}', '{_WRITTEN}'),
               '[\x{{4e00}}-\x{{9fff}}]+')) AS run FROM documents) GROUP BY run""",
    True,
)
_part(
    "run_ends",
    """SELECT run, n, last, size FROM (SELECT *, unnest(range(1, length(run) + 1)) AS last FROM text_runs),
       (SELECT unnest([1, 2, 3, 4]) AS size)""",
    True,
)
_part(
    "run_counts",
    """SELECT substr(run, last - size + 1, size) AS word, sum(n)::BIGINT AS n FROM run_ends WHERE size <= last
       GROUP BY 1 HAVING any_value(size) = 1 OR sum(n) >= 20""",
    True,
)
_part(
    "run_list",
    """SELECT word, n, round(1000000 * (ln(n) - ln((SELECT sum(n) FROM run_counts WHERE length(word) = 1))))::BIGINT AS weight
       FROM run_counts""",
    True,
)
_part(
    "lattice",
    """SELECT run, n, list(weight ORDER BY last, size) AS e,
              string_agg(word, '/' ORDER BY last - size, size) FILTER (weight IS NOT NULL) AS full_words
       FROM (SELECT run, n, last, size, CASE WHEN size <= last THEN substr(run, last - size + 1, size) END AS word FROM run_ends)
       LEFT JOIN (SELECT word, weight FROM run_list) w USING (word) GROUP BY run, n""",
    True,
)
_part(
    "path_steps",
    """SELECT run, e, 0 AS done, 0::BIGINT AS s1, NULL::BIGINT AS s2, NULL::BIGINT AS s3, NULL::BIGINT AS s4,
              '' AS p1, '' AS p2, '' AS p3, '' AS p4 FROM lattice
       UNION ALL
       SELECT run, e, done + 1, best, s1, s2, s3,
              CASE best WHEN c4 THEN p4 || '/' || substr(run, done - 2, 4) WHEN c3 THEN p3 || '/' || substr(run, done - 1, 3)
                WHEN c2 THEN p2 || '/' || substr(run, done, 2) ELSE p1 || '/' || substr(run, done + 1, 1) END, p1, p2, p3
       FROM (SELECT *, greatest(c1, c2, c3, c4) AS best FROM (
               SELECT *, s1 + e[4 * done + 1] AS c1, s2 + e[4 * done + 2] AS c2, s3 + e[4 * done + 3] AS c3,
                      s4 + e[4 * done + 4] AS c4 FROM path_steps WHERE done < length(run)))""",
)
_part("best_paths", "SELECT run, substr(p1, 2) AS precise FROM path_steps WHERE done = length(run)", True)
_part(
    "path_words",
    """SELECT run, unnest(string_split(precise, '/')) AS part, generate_subscripts(string_split(precise, '/'), 1) AS k
       FROM best_paths""",
)
_part(
    "path_inside",
    """SELECT run, string_agg(word, '/' ORDER BY k, b, size) AS search FROM (
         SELECT run, k, b, size, substr(part, b, size) AS word
         FROM (SELECT *, unnest(range(1, length(part) + 1)) AS b FROM path_words), (SELECT unnest([1, 2, 3, 4]) AS size)
         WHERE b + size - 1 <= length(part))
       JOIN run_list USING (word) GROUP BY run""",
)

_FINAL = {
    "flatten_results": _RESULT.format(content="content"),
    "assign_ids": """
        SELECT row_number() OVER (ORDER BY conv_id, page, pos) - 1 AS cId, conv_id, page, pos, score FROM results""",
    "format_comments": """
        SELECT CAST(1000 AS BIGINT) AS pId, row_number() OVER (ORDER BY conv_id, page, pos) - 1 AS cId,
               content, score FROM results""",
    "counter_ids": """
        SELECT 'part ' || part AS delivery, n, n AS n_ids, first, first + n - 1 AS last FROM (
          SELECT *, CAST(sum(n) OVER (ORDER BY part) - n AS BIGINT) AS first FROM (
            SELECT conv_id % 3 AS part, count(*) AS n FROM results GROUP BY ALL))
        JOIN (SELECT unnest([0, 1, 1, 2]) AS run) ON run = part""",
    "normalise_newlines": "SELECT doc_id, replace(text, chr(10), '。') AS content FROM documents",
    "run_words": "SELECT word, n, weight FROM run_list",
    "segmented_runs": """
        SELECT run, n, precise, full_words AS "full", search
        FROM lattice JOIN best_paths USING (run) JOIN path_inside USING (run)""",
    "repeat_ratio": r"""
        SELECT doc_id, 1 - len(list_distinct(parts)) / len(parts) AS ratio FROM (
          SELECT doc_id, string_split(coalesce(array_to_string(regexp_extract_all(text, '[\p{L}\p{N}]+'), '/'), ''), '/') AS parts
          FROM documents)""",
    "purge_comments": "SELECT * FROM purged",
    "element_check": r"SELECT * FROM purged WHERE regexp_matches(content, '[^A-Za-z0-9\p{P}\p{S}\s]')",
    "jsonp_comments": _RESULT.format(content="replace(content, chr(10), '。')"),
    "gbk_pages": r"""
        SELECT conv_id, page, pos, replace(regexp_replace(translate(content, @plain, @cjk),
               '[^\x00-\x7f\x{4e00}-\x{9fff}]', '?', 'g'), chr(10), '。') AS content, score FROM results""".replace(
        "@plain", "'abcdefghijklmnopqrstuvwxyz'"
    ).replace("@cjk", "'" + "".join(chr(0x4E00 + i) for i in range(26)) + "'"),
    "xml_parse": "SELECT * FROM digest",
    "xml_sentence_map": """
        SELECT cid AS cId, CAST(count(DISTINCT sid) AS INTEGER) AS n_sentences, CAST(count(*) AS INTEGER) AS n_words
        FROM words GROUP BY cid""",
    "task_parses": "SELECT * FROM digest WHERE cId % 10 <> 7",
    "json_first_sentence": """
        SELECT cId, text FROM (SELECT cId, text, row_number() OVER (PARTITION BY cId ORDER BY sId) AS rn FROM digest)
        WHERE rn = 1""",
    "skipped_rows": """
        SELECT 'task results' AS source, reason, count(*) AS n FROM (
          SELECT CASE WHEN doc_id % 10 = 7 THEN 'failed' WHEN doc_id % 13 = 5 THEN 'empty'
                      WHEN doc_id % 11 = 3 THEN 'broken' WHEN doc_id % 17 = 9 THEN 'no comment' END AS reason
          FROM documents) WHERE reason IS NOT NULL GROUP BY reason
        UNION ALL
        SELECT 'xml parses', reason, count(*) FROM (
          SELECT CASE WHEN doc_id % 19 = 6 OR text IS NULL THEN 'empty' WHEN doc_id % 9 = 4 THEN 'broken' END AS reason
          FROM documents) WHERE reason IS NOT NULL GROUP BY reason
        UNION ALL
        SELECT 'opinions', 'no clause', count(*) FROM accepted WHERE (cid + sid) % 17 = 0 HAVING count(*) > 0
        UNION ALL
        SELECT 'task results', 'clauses read', count(*) FROM clauses
        WHERE cid % 10 <> 7 AND cid % 13 <> 5 AND cid % 11 <> 3 AND cid % 17 <> 9
        UNION ALL
        SELECT 'xml parses', 'clauses read', count(*) FROM clauses WHERE cid % 19 <> 6 AND cid % 9 <> 4""",
    "html_fields": """
        SELECT conv_id, page, pos, CAST(conv_id + pos AS INTEGER) AS votes,
               CASE WHEN pos % 3 > 0 THEN score ELSE 0 END AS rating, content AS text FROM results""",
    "html_references": """
        SELECT doc_id, text || ' ' || CASE doc_id % 11
            WHEN 0 THEN '&lt;' WHEN 1 THEN '&lt;' WHEN 2 THEN 'AB' WHEN 3 THEN chr(128512)
            WHEN 4 THEN '&#55357;&#56832;' WHEN 5 THEN '&#99999999;' WHEN 6 THEN '&#xffffffffff;' WHEN 7 THEN '&#0;'
            WHEN 8 THEN '&unknown; & &' WHEN 9 THEN '<b>' ELSE chr(34) || chr(39) || ' ' END AS content
        FROM documents""",
    "page_plan": """
        SELECT pId, CAST(page AS INTEGER) AS page,
               'https://shop.example.com/reviews?callback=cb' || pId
               || '&product=' || pId || '&page=' || page || '&size=10' AS url
        FROM (SELECT pId, unnest(range(maxsize // 10)) AS page
              FROM (SELECT CAST(substr(source, 4) AS BIGINT) AS pId, count(*) AS maxsize FROM documents GROUP BY ALL))""",
    "set_query_param": r"""
        SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || '?' ||
               array_to_string(list_append(list_filter(
                 string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
                 lambda p: regexp_matches(p, '^[^=]*=.') AND NOT starts_with(p, 'page=')), 'page=' || page_id), '&')
               || regexp_extract(url, '(#.+)$', 1) AS url
        FROM pages""",
    "latest_pages": """
        SELECT url, page_id, code, CAST(length(html) AS INTEGER) AS n_chars,
               strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at FROM latest""",
    "upserted_pages": """
        SELECT url, page_id, code, CAST(length(html) AS INTEGER) AS n_chars,
               strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at FROM cache
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC) = 1""",
    "cached_pages": "SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM latest)",
    "fetch_plan": """
        SELECT * FROM (
          SELECT p.page_id, p.url,
                 CASE WHEN l.url IS NULL THEN 'uncached' WHEN l.code BETWEEN 500 AND 599 THEN 'server error'
                      WHEN l.html IS NULL OR l.html = '' THEN 'empty' END AS reason
          FROM pages p LEFT JOIN latest l ON l.url = p.url)
        WHERE reason IS NOT NULL""",
    "export_rated_lines": "SELECT value FROM lines",
    "dep_pairs_base": _PAIR.format(more="") + " WHERE kind = 'base'",
    "dep_pairs_coo_dependent": _PAIR.format(more="") + " WHERE kind = 'dependent'",
    "dep_pairs_coo_head": _PAIR.format(more="") + " WHERE kind = 'head'",
    "dep_pairs_cross": _PAIR.format(more="") + " WHERE kind = 'cross'",
    "dep_pairs_all": _PAIR.format(more=", kind"),
    "flat_pairs_view": _PAIR.format(more=""),
    "seed_pass": f"""
        SELECT {_OPINION}, CASE WHEN NOT fok THEN 1 WHEN NOT seed THEN 0 WHEN sok AND spos = 'a' THEN -1 ELSE 1 END AS label
        FROM sides""",
    "bootstrap_labels": f"SELECT {_OPINION}, label FROM marked",
    "grown_labels": """
        SELECT pid AS pId, f, fpos, s, spos, seed, n, label FROM labelled""",
    "feature_sentiment_pairs": f"SELECT {_OPINION} FROM accepted",
    "nested_opinions": """
        SELECT pId, cId, string_agg(line, ';' ORDER BY sid) AS opinions FROM (
          SELECT pid AS pId, cid AS cId, sid,
                 sid || ':' || string_agg(f || '-' || s || '-' || relate, ',' ORDER BY pno) AS line
          FROM accepted GROUP BY pid, cid, sid)
        GROUP BY pId, cId""",
    "feature_lexicon": "SELECT pid AS pId, name, freq FROM features",
    "sentiment_lexicon": """
        SELECT pid AS pId, s AS name, CAST(sum(n) AS BIGINT) AS freq FROM labelled
        WHERE by_side = 's' OR label = -1 GROUP BY pid, s HAVING sum(n) > 3""",
    "negation_words": f"SELECT {_OPINION}, neg_id, neg_word FROM with_negs",
    "clause_context": f"SELECT {_OPINION}, neg_id, neg_word FROM tuples",
    "adversative_reset": f"SELECT {_OPINION} FROM tuples",
    "negated_tuples": f"SELECT {_OPINION}, neg_id, neg_word FROM tuples WHERE neg_word IS NOT NULL",
    "clean_lexicon": r"""
        SELECT DISTINCT word FROM (
          SELECT word FROM (SELECT unnest(string_split_regex(translate(lower(text), @plain, @cjk), '[ \n]')) AS word FROM documents)
          WHERE regexp_matches(word, '^[\x{4e00}-\x{9fff}]+$')
          UNION ALL
          SELECT unnest(string_split_regex(translate(lower(text), @plain, @cjk), '[ \n]')) FROM benchmark)
        WHERE word <> ''""".replace("@plain", "'abcdefghijklmnopqrstuvwxyz'").replace(
        "@cjk", "'" + "".join(chr(0x4E00 + i) for i in range(26)) + "'"
    ),
    "word_list_files": r"""
        SELECT word, polarity FROM (
          SELECT DISTINCT unnest(string_split_regex(lower(text), '\s+')) AS word FROM documents),
          (SELECT unnest([-1, 1]) AS polarity)
        WHERE contains(word, CASE polarity WHEN -1 THEN 'a' ELSE 'e' END)""",
    "synonym_polarity": "SELECT word, polarity FROM polarity",
    "tuple_degrees": f"SELECT {_OPINION}, deg_value FROM degrees",
    "comment_degree": "SELECT pid AS pId, cid AS cId, degree AS cDegValue FROM comment_degrees",
    "flat_degrees": f"SELECT {_OPINION}, deg_value FROM degrees WHERE deg_value <> 0",
    "flat_degrees_view": """
        SELECT pid AS pId, cid AS cId, sid AS sId, f AS feature, s AS sentiment, neg_word, relate, deg_value
        FROM degrees""",
    "classification_quality": """
        SELECT *, p * r * 2 / (p + r) AS f FROM (
          SELECT *, tp / predicted_true AS p, tp / actual_true AS r FROM (
            SELECT count(*) FILTER (degree > 0.5 AND score > 3) AS tp, count(*) FILTER (degree > 0.5) AS predicted_true,
                   count(*) FILTER (score > 3) AS actual_true, count(*) AS all_count
            FROM comment_degrees d LEFT JOIN rated r ON r.cid = d.cid AND r.pid = d.pid))""",
    "feature_tags": "SELECT * FROM tags",
    "merged_tags": "SELECT * FROM tags",
    "tag_comments": """
        SELECT DISTINCT s.pid AS pId, s.f AS tFeature, s.good AS tIsGood, s.cid AS cId
        FROM shown s JOIN features v ON v.pid = s.pid AND v.name = s.f""",
    "hot_tags": "SELECT * FROM hot",
    "product_totals": "SELECT * FROM totals",
    "append_summaries": "SELECT * FROM totals",
    "product_summary": """
        SELECT t.*, coalesce(p.line, '') AS hotPos, coalesce(n.line, '') AS hotNeg FROM totals t
        LEFT JOIN (SELECT pId, string_agg(concat_ws('/', tFeature, tSentiment, tCount, tCommentCount), ',' ORDER BY "rank") AS line
                   FROM hot WHERE tIsPos GROUP BY pId) p ON p.pId = t.pId
        LEFT JOIN (SELECT pId, string_agg(concat_ws('/', tFeature, tSentiment, tCount, tCommentCount), ',' ORDER BY "rank") AS line
                   FROM hot WHERE NOT tIsPos GROUP BY pId) n ON n.pId = t.pId""",
    "word_count": "SELECT word, n FROM counts",
    "stop_words": "SELECT word, n FROM stops",
    "stopword_filter": """
        SELECT cId, CAST(len(kept) AS INTEGER) AS n, coalesce(array_to_string(kept, ' '), '') AS kept FROM (
          SELECT cid AS cId, list_filter(tokens, lambda x: NOT list_contains(words, x)) AS kept
          FROM tokens, (SELECT list(word) AS words FROM stops))""",
    "balanced_sample": """
        SELECT rating, 0 AS label, md5(text) AS hash FROM rated_text WHERE rating < 4
        UNION ALL
        SELECT rating, 1, hash FROM (
          SELECT rating, md5(text) AS hash, row_number() OVER (ORDER BY md5(text), text) AS rn
          FROM rated_text WHERE rating = 5)
        WHERE rn <= (SELECT count(*) FROM rated_text WHERE rating < 4)""",
    "tfidf_weights": """
        SELECT cId, word, tf, round(tf * ln(((SELECT count(*) FROM rated) + 1.0) / (df + 1.0)), 6) AS tfidf FROM (
          SELECT *, count(*) OVER (PARTITION BY word) AS df FROM (
            SELECT cid AS cId, word, count(*) AS tf FROM (SELECT cid, unnest(tokens) AS word FROM tokens)
            GROUP BY ALL))""",
    "split_counts": """
        SELECT label, CASE WHEN training THEN 'training' ELSE 'test' END AS part, count(*) AS n
        FROM bayes_tokens GROUP BY ALL""",
    "bayes_weights": "SELECT word, round(negative, 6) AS negative, round(positive, 6) AS positive FROM bayes_model",
    "bayes_accuracy": """
        SELECT count(*) AS n_test, count(*) FILTER (predicted = label) AS n_right,
               count(*) FILTER (predicted = label) / count(*) AS accuracy
        FROM (SELECT t.label, CASE WHEN coalesce(odds, 0) + prior > 0 THEN 1 ELSE 0 END AS predicted
              FROM bayes_tokens t
              LEFT JOIN (SELECT row, sum(positive - negative) AS odds FROM bayes_words JOIN bayes_model USING (word)
                         WHERE NOT training GROUP BY row) o ON o.row = t.row,
              (SELECT ln(count(*) FILTER (label = 1) / count(*) FILTER (label = 0)) AS prior FROM bayes_tokens WHERE training)
              WHERE NOT training)""",
    "stream_ingest": """
        SELECT conv_id || '-' || page AS _id, pos, content, score FROM (
          SELECT *, 1 - len(list_distinct(parts)) / len(parts) AS ratio FROM (
            SELECT conv_id, page, pos, score, replace(content, chr(10), '。') AS content,
                   string_split(coalesce(array_to_string(regexp_extract_all(
                     replace(content, chr(10), '。'), '[\\p{L}\\p{N}]+'), '/'), ''), '/') AS parts
            FROM results))
        WHERE length(content) BETWEEN 4 AND 100 AND NOT ratio > 0.5 AND NOT regexp_matches(content, '@url')""".replace(
        "@url", _URL
    ),
}


def _complete(query: str, changed: dict[str, str] | None = None) -> str:
    """``query`` with all the parts it needs in front; ``changed`` parts take the place of others."""
    parts = {**_PARTS, **(changed or {})}
    needed: set[str] = set()
    texts = [query]
    while texts:
        text = texts.pop()
        for name, body in parts.items():
            if name not in needed and re.search(rf"\b{name}\b(?!\.)", text):
                needed.add(name)
                texts.append(body)
    # parts that only a changed one needs come before all others
    first = [parts[name] for name in ("sentences", "ratios", "purged") if changed and name in needed]
    rest = [body for name, body in parts.items() if name in needed and body not in first]
    return f"WITH RECURSIVE {', '.join(first + rest)} {query}" if needed else query


#: Purged sentences as comments of one clause, numbered over all products.
_PURGED_CLAUSES = """clauses AS MATERIALIZED (
SELECT pId AS pid, row_number() OVER (ORDER BY pId, cId, sId) - 1 AS cid, 0 AS sid, lower(content) AS content FROM purged)"""

ORACLE: dict[str, str] = {name: _complete(query) for name, query in _FINAL.items()}
#: Too slow beyond the smallest tables: tests only.
SMALL_TABLES: dict[str, str] = {"segmented_runs": ORACLE.pop("segmented_runs")}
ORACLE["reviews_to_summary"] = _complete(_FINAL["product_summary"], {"clauses": _PURGED_CLAUSES})
