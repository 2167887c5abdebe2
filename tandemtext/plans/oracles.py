"""The same inputs and results in SQL, for checking against another engine.

Every query is one statement over the test tables. Shared inputs are common table
expressions, put in front of the final SELECT by :func:`sql`.
"""

from __future__ import annotations

from tandemtext.functions.bleu import (
    BROKEN_WORD,
    DASH_AFTER_DIGIT,
    ENTITIES,
    SKIPPED,
    STOP_AFTER_NON_DIGIT,
    STOP_BEFORE_NON_DIGIT,
)
from tandemtext.functions.text import GAP, TREEBANK, WORD

LINES = """
line_pairs AS (
  SELECT doc_id || '-' || (i - 1) AS id, doc_id, lang, source, i - 1 AS pos,
         l[i] AS en, l[i + 1] AS es
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l,
               unnest(range(1, len(string_split(text, chr(10))))) AS i
        FROM documents))"""

TURNS = """
turn_pairs AS (
  SELECT a.conv_id || '-' || a.turn AS id, a.conv_id, a.turn, a.text AS en, b.text AS es
  FROM conversations a JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')"""

PAIRS = """
pairs AS (
  SELECT 'lines-' || id AS id, en, es FROM line_pairs
  UNION ALL SELECT 'turns-' || id, en, es FROM turn_pairs)"""

CLEAN = """
clean AS (SELECT * FROM pairs WHERE en <> es AND length(en) >= 10)"""


def order_key(key: str, seed: int | str = 42) -> str:
    return f"(md5('{seed}|' || {key}) || '|' || {key})"


def split_cte(name: str, rows: str, key: str, train: str, seed: int | str = 42) -> str:
    return f"""
{name} AS (
  SELECT * EXCLUDE (r, n, n_train),
    CASE WHEN r <= n_train THEN 'train'
         WHEN r <= n_train + ceil((n - n_train) * CAST(0.5 AS DOUBLE)) THEN 'test'
         ELSE 'valid' END AS split
  FROM (SELECT *, {train} AS n_train
        FROM (SELECT *, row_number() OVER (ORDER BY {order_key(key, seed)}) AS r,
                     count(*) OVER () AS n FROM {rows})))"""


SPLIT = split_cte("split_pairs", "clean", "id", "floor(n * CAST(0.7 AS DOUBLE))")

CANDIDATES = """
candidates AS (
  SELECT *, lower(es) AS "echo-lower",
    array_to_string(list_filter(string_split(es, ' '), lambda w, i: i % 3 <> 0), ' ')
      AS "drop-third.v1",
    array_to_string(list_reverse(string_split(es, ' ')), ' ') AS "words-reversed"
  FROM split_pairs)"""


# The signs of the 13a tokenization as its published pattern groups them.
SIGN = (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ")


def tokens_13a(text: str) -> str:
    out = rf"regexp_replace({text}, '\s+$', '')"
    out = f"replace({out}, '{SKIPPED}', '')"
    out = f"replace({out}, '{BROKEN_WORD[0]}' || chr(10), '')"
    out = f"replace({out}, chr(10), ' ')"
    for entity, sign in ENTITIES:
        out = f"replace({out}, '{entity}', '{sign}')"
    out = f"' ' || {out} || ' '"
    for pattern, spacing in (SIGN, STOP_AFTER_NON_DIGIT, STOP_BEFORE_NON_DIGIT, DASH_AFTER_DIGIT):
        out = f"regexp_replace({out}, '{pattern}', '{spacing}', 'g')"
    return rf"list_filter(regexp_split_to_array({out}, '\s+'), lambda w: w <> '')"


def stats_ctes(rows: str, key: str, prediction: str, reference: str) -> str:
    """``stats``: key, sys_len, ref_len, c1..c4, t1..t4 for rows of pairs."""
    counts = ", ".join(f"coalesce(sum(m) FILTER (n = {n}), 0) AS c{n}" for n in range(1, 5))
    totals = ", ".join(f"greatest(sys_len - {n - 1}, 0) AS t{n}" for n in range(1, 5))
    columns = ", ".join(f"coalesce(c{n}, 0) AS c{n}" for n in range(1, 5))

    def grams(side: str) -> str:
        return f"""
  SELECT {key}, n, g, count(*) AS c FROM (
    SELECT {key}, n, unnest(list_transform(range(1, len({side}) - n + 2),
             lambda i: array_to_string({side}[i : i + n - 1], ' '))) AS g
    FROM toks, (VALUES (1), (2), (3), (4)) orders(n))
  GROUP BY ALL"""

    return f"""
toks AS (SELECT {key}, {tokens_13a(prediction)} AS p, {tokens_13a(reference)} AS r FROM {rows}),
p_grams AS ({grams("p")}),
r_grams AS ({grams("r")}),
matches AS (
  SELECT {key}, {counts}
  FROM (SELECT {key}, n, least(a.c, b.c) AS m FROM p_grams a JOIN r_grams b USING ({key}, n, g))
  GROUP BY {key}),
stats AS (
  SELECT {key}, sys_len, ref_len, {columns}, {totals}
  FROM (SELECT {key}, len(p) AS sys_len, len(r) AS ref_len FROM toks)
  LEFT JOIN matches USING ({key}))"""


def brevity() -> str:
    return (
        "CASE WHEN sys_len >= ref_len THEN 1.0 WHEN sys_len = 0 THEN 0.0 "
        "ELSE exp(1 - ref_len / CAST(sys_len AS DOUBLE)) END"
    )


def smoothed(n: int) -> str:
    """Percent precision of order ``n``."""
    misses = " + ".join(f"CAST(c{i} = 0 AND t{i} > 0 AS INT)" for i in range(1, n + 1))
    return (
        f"CASE WHEN t{n} = 0 OR c1 = 0 THEN 0.0 "
        f"WHEN c{n} = 0 THEN 100.0 / (pow(2.0, {misses}) * t{n}) "
        f"ELSE 100.0 * c{n} / CAST(t{n} AS DOUBLE) END"
    )


def score() -> str:
    logs = " + ".join(f"ln(CASE WHEN t4 = 0 OR c1 = 0 THEN 1 ELSE {smoothed(n)} END)" for n in range(1, 5))
    return f"CASE WHEN t4 = 0 OR c1 = 0 THEN 0.0 ELSE ({brevity()}) * exp(({logs}) / 4) END"


def plain_score() -> str:
    logs = " + ".join(
        f"ln(CASE WHEN c4 = 0 THEN 1 ELSE c{n} / CAST(t{n} AS DOUBLE) END)" for n in range(1, 5)
    )
    return f"CASE WHEN c4 = 0 THEN 0.0 ELSE ({brevity()}) * exp(({logs}) / 4) END"


LONG_CANDIDATES = """
long_candidates AS (
  SELECT id || '/1' AS k, "echo-lower" AS p, es FROM candidates
  UNION ALL SELECT id || '/2', "drop-third.v1", es FROM candidates
  UNION ALL SELECT id || '/3', "words-reversed", es FROM candidates)"""

SCORED = (
    LONG_CANDIDATES
    + ","
    + stats_ctes("long_candidates", "k", "p", "es")
    + f""",
scores AS (SELECT k, {score()} AS score FROM stats),
scored AS (
  SELECT c.*, a.score AS "echo-lower_score", b.score AS "drop-third.v1_score",
         d.score AS "words-reversed_score"
  FROM candidates c
  JOIN scores a ON a.k = c.id || '/1'
  JOIN scores b ON b.k = c.id || '/2'
  JOIN scores d ON d.k = c.id || '/3')"""
)

LOG_LINES = r"""
log_docs AS (SELECT doc_id, lang, source, text, string_split(text, chr(10)) AS l FROM documents),
log_messages AS (
  SELECT doc_id, lang, source, 0 AS seq, '===================== RUN =====================' AS message FROM log_docs
  UNION ALL SELECT doc_id, lang, source, 1, 'MODEL: hub/' || source FROM log_docs
  UNION ALL SELECT doc_id, lang, source, 2, 'HYPERPARAMETERS:' FROM log_docs
  UNION ALL SELECT doc_id, lang, source, 3, chr(9) || 'EPOCHS: 9' FROM log_docs
  UNION ALL SELECT doc_id, lang, source, 4, chr(9) || 'EPOCHS: 1' || (length(source) - 3) FROM log_docs
  UNION ALL SELECT doc_id, lang, source, 5, chr(9) || 'TRAINING SIZE: ' || length(text) FROM log_docs
  UNION ALL SELECT doc_id, lang, source, 6, 'PRE-EVALUATION (VALIDATION): {''eval_loss'': ' || doc_id
      || '.5, ''eval_counts'': [1, 2], ''eval_norm'': '
      || ['nan', 'inf', '-inf', 'None', 'True'][1 + doc_id % 5]
      || ', ''eval_size'': ' || length(text) || '}' FROM log_docs
  UNION ALL SELECT doc_id, lang, source, 7, 'POST-EVALUATION (TEST): {''eval_loss'': ' || doc_id
      || '.5, ''epoch'': 2.0}' FROM log_docs
  UNION ALL SELECT doc_id, lang, source, 8 + 5 * pos,
      'TRANSLATION ' || pos || ' on "English to Spanish"' FROM line_pairs
  UNION ALL SELECT doc_id, lang, source, 9 + 5 * pos, chr(9) || 'Original Text: ' || en FROM line_pairs
  UNION ALL SELECT doc_id, lang, source, 10 + 5 * pos,
      chr(9) || 'Generated Translation: ' || lower(en) FROM line_pairs
  UNION ALL SELECT doc_id, lang, source, 11 + 5 * pos, chr(9) || 'Actual Translation: ' || es FROM line_pairs
  UNION ALL SELECT doc_id, lang, source, 12 + 5 * pos, en FROM line_pairs),
log_lines AS (
  SELECT 'finetune-' || lang || '.log' AS file, doc_id * 4294967296 + seq AS line_no,
    CASE WHEN seq >= 8 AND (seq - 8) % 5 = 4 THEN message
         ELSE 'VERSION 1.1.' || replace(source, 'src', '') || ' : '
           || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 60 + seq),
                       '%Y-%m-%d %H:%M:%S') || ' : ' || message END AS value
  FROM log_messages)"""

# As files hold them: one after the other.
FILED_LINES = """
filed AS (
  SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS line_no, value
  FROM log_lines)"""

PARSED = r"""
parsed_0 AS (
  SELECT *, regexp_matches(value, '(?s)^VERSION (\S+) : (\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) : (.*)$') AS ok,
    regexp_extract(value, '(?s)^VERSION (\S+) : (\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) : (.*)$',
                   ['v', 't', 'm']) AS x
  FROM log_lines),
parsed AS (
  SELECT file, line_no, value, CASE WHEN ok THEN x.v END AS version,
    CASE WHEN ok THEN TRY_CAST(x.t AS TIMESTAMP) END AS ts,
    CASE WHEN ok THEN x.m ELSE value END AS message,
    trim(CASE WHEN ok THEN x.m ELSE value END, ' ' || chr(9) || chr(10) || chr(13)) AS stripped
  FROM parsed_0),
numbered AS (
  SELECT *,
    sum(CAST(version IS NOT NULL AND stripped = '===================== RUN =====================' AS INT))
      OVER w AS run_no,
    sum(CAST(version IS NOT NULL AS INT)) OVER w AS record_no,
    sum(CAST(version IS NOT NULL AND regexp_matches(stripped, '^([A-Z() ]+):$') AS INT))
      OVER w AS section_no
  FROM parsed
  WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING))"""

# Common table expressions by name, in an order in which each only uses earlier ones.
PARTS = {
    "line_pairs": LINES,
    "turn_pairs": TURNS,
    "pairs": PAIRS,
    "clean": CLEAN,
    "split_pairs": SPLIT,
    "candidates": CANDIDATES,
    "scored": SCORED,
    "log_lines": LOG_LINES,
    "filed": FILED_LINES,
    "numbered": PARSED,
}
NEEDS = {
    "pairs": ("line_pairs", "turn_pairs"),
    "clean": ("pairs",),
    "split_pairs": ("clean",),
    "candidates": ("split_pairs",),
    "scored": ("candidates",),
    "log_lines": ("line_pairs",),
    "filed": ("log_lines",),
    "numbered": ("log_lines",),
}


def _closure(name: str) -> set[str]:
    return {name}.union(*[_closure(other) for other in NEEDS.get(name, ())])


def sql(final: str, *inputs: str, extra: str = "") -> str:
    """A statement with the named inputs, and ``extra`` expressions behind them."""
    wanted = set().union(*[_closure(name) for name in inputs]) if inputs else set()
    ctes = [text for name, text in PARTS.items() if name in wanted]
    if extra:
        ctes.append(extra)
    return (f"WITH {','.join(ctes)}\n" if ctes else "") + final.strip()


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '{WORD}')"


def treebank_words(text: str) -> str:
    def quoted(value: str) -> str:
        return value.replace("'", "''")

    for pattern, replacement in TREEBANK:
        text = f"regexp_replace({text}, '{quoted(pattern)}', '{quoted(replacement)}', 'g')"
    return f"list_filter(regexp_split_to_array({text}, '{GAP}+'), lambda w: w <> '')"
