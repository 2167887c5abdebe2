"""The results of the operators in SQL, spelled out for another engine."""

EXACT_COPIES = r"""
WITH texts AS (
    SELECT doc_id, length(coalesce(text, '')) AS len,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER staying AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER staying = 1 AS kept,
       text_sha256
FROM texts
WINDOW staying AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)"""

# The sources fill up one after the other: the first whose share is no more than its cap sets
# the words for a unit of weight. The same rule by running sums of the whole hash order.
MIXING = r"""
WITH sized AS (
    SELECT doc_id, source,
           CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           CAST('0x' || substr(md5('mix|' || concat_ws('|', CAST(doc_id AS VARCHAR),
               CAST(length(text) AS VARCHAR))), 1, 13) AS BIGINT) AS hash
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][
               1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS weight
    FROM sized GROUP BY source
), capped AS (
    SELECT *, source_size * 3.0::DOUBLE AS cap,
           (sum(source_size) OVER ())::DOUBLE * 1.0::DOUBLE AS budget, sum(weight) OVER () AS weights,
           row_number() OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST) AS place
    FROM sources
), levels AS (
    SELECT *,
           (budget - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / (weights - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           AS level
    FROM capped
), targets AS (
    SELECT source, source_size,
           least(cap, (SELECT arg_min(level, place) FROM levels WHERE level * weight <= cap) * weight) AS target
    FROM levels
), planned AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets
), ordered AS (
    SELECT s.doc_id, s.size, p.source_size, p.target, p.whole,
           p.target - p.whole * p.source_size AS budget,
           sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash RANGE UNBOUNDED PRECEDING) AS upto,
           sum(s.size) OVER (PARTITION BY s.source, s.hash) AS words
    FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN upto <= budget
                                 OR upto - words <= budget AND 2 * (budget - (upto - words)) >= words
                            THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered"""

CONTAMINATION = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), phrases AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item_words WHERE len(w) > 0)
), lengths AS (
    SELECT DISTINCT n FROM phrases
), starts AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths)
), hits AS (
    SELECT s.doc_id, s.i, s.n, p.item_id FROM starts s JOIN phrases p ON s.phrase = p.phrase AND s.n = p.n
), covered AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id
), owners AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items,
       sha256(coalesce(o.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c USING (doc_id) LEFT JOIN owners o USING (doc_id)"""

REPEATS = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS words
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)
), later AS (
    SELECT doc_id, i FROM windows
    QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1
), removed AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS place FROM later
), spread AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM words
), kept AS (
    SELECT s.doc_id, string_agg(s.word, ' ' ORDER BY s.place) AS text
    FROM spread s ANTI JOIN removed r ON s.doc_id = r.doc_id AND s.place = r.place GROUP BY s.doc_id
), counts AS (
    SELECT doc_id, count(*) AS n_removed FROM removed GROUP BY doc_id
)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(c.n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN counts c USING (doc_id) LEFT JOIN kept k USING (doc_id)"""

NEAR_COPIES = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram
    FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
    WHERE common.n * 5 >= (x.n + y.n - common.n) * 4
), reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
), classes AS (
    SELECT doc_id, min(other) AS class_id, count(*) AS class_size FROM reached GROUP BY doc_id
)
SELECT doc_id, class_id, class_size, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links FROM classes"""

# All distances to all entries, twice for the rounds and once for the codes.
_NEAREST = """
    SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) AS best
    FROM (
        SELECT p.vec_id, p.part, b.entry, CAST(sum((p.x - b.x) * (p.x - b.x)) AS BIGINT) AS d
        FROM parts p JOIN {book} b USING (part, pos) GROUP BY ALL
    ) GROUP BY ALL"""
_MOVED = """
    SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x
    FROM {book} b LEFT JOIN (
        SELECT p.part, n.best.entry AS entry, p.pos,
               CAST((sum(p.x) - ((sum(p.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
        FROM parts p JOIN {near} n USING (vec_id, part) GROUP BY ALL
    ) m USING (part, entry, pos)"""
VECTOR_CODES = f"""
WITH kept AS (
    SELECT vec_id, label, embedding FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), flat AS (
    SELECT vec_id, unnest(embedding) AS c, unnest(range(len(embedding))) AS i, len(embedding) // 16 AS width
    FROM kept
), parts AS (
    SELECT vec_id, i // width AS part, i % width AS pos, CAST(floor(256 * c::DOUBLE) AS BIGINT) AS x FROM flat
), starts AS (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64
), book0 AS (
    SELECT part, entry, pos, x FROM parts JOIN starts USING (vec_id)
), near0 AS ({_NEAREST.format(book="book0")}
), book1 AS ({_MOVED.format(book="book0", near="near0")}
), near1 AS ({_NEAREST.format(book="book1")}
), book2 AS ({_MOVED.format(book="book1", near="near1")}
), near2 AS ({_NEAREST.format(book="book2")}
), coded AS (
    SELECT vec_id, string_agg(lower(printf('%02x', best.entry)), '' ORDER BY part) AS code,
           CAST(sum(best.d) AS BIGINT) AS error
    FROM near2 GROUP BY vec_id
)
SELECT vec_id, code, error,
       CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""
