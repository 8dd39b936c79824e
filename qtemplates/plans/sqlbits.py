"""DuckDB SQL fragments for the oracle queries.

These are the same rules as ``qtemplates.functions.text`` written for an
independent engine (RE2 regexes, DuckDB list functions), so a driver can
check each Spark query against plain SQL on the same Parquet tables.
"""

from __future__ import annotations


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def first_n(x: str, n: int) -> str:
    return f"array_to_string(list_slice({words(x)}, 1, {n}), ' ')" if n > 0 else "''"


def last_n(x: str, n: int) -> str:
    if n <= 0:
        return "''"
    w = words(x)
    return f"array_to_string(list_slice({w}, greatest(len({w}) - {n} + 1, 1), len({w})), ' ')"


def normalize(x: str) -> str:
    t = strip(f"coalesce({x}, '')")
    t = f"regexp_replace({t}, '(?i)\\bec\\d+\\b', 'EC', 'g')"
    t = f"regexp_replace({t}, '(?i)\\bpc\\d+\\b', 'PC', 'g')"
    return f"regexp_replace({t}, '\\s+', ' ', 'g')"


def pattern(x: str, n: int = 5) -> str:
    w = words(f"regexp_replace({strip(x)}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')")
    return f"CASE WHEN len({w}) > 0 THEN lower(array_to_string(list_slice({w}, 1, {n}), ' ')) END"


def hash_test(key: str, test_cut: str = "33333333", seed: int = 42) -> str:
    return f"(substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8) < '{test_cut}')"


# Non-blank lines of every document, numbered from 0 inside the document.
DOC_LINES = """
raw_lines AS (
  SELECT doc_id, lang, generate_subscripts(s, 1) - 1 AS line_no, unnest(s) AS line
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS s FROM documents)
),
doc_lines AS (
  SELECT doc_id, lang, line_no, line FROM raw_lines WHERE {nonblank}
)""".replace("{nonblank}", f"{strip('line')} <> ''")


BENCH_LINES = """
bench_raw AS (
  SELECT item_id, generate_subscripts(s, 1) - 1 AS line_no, unnest(s) AS line
  FROM (SELECT item_id, string_split(text, chr(10)) AS s FROM benchmark)
),
bench_lines AS (
  SELECT item_id, line_no, line FROM bench_raw WHERE {nonblank}
)""".replace("{nonblank}", f"{strip('line')} <> ''")


def bleu_sides(train_src: str, test_src: str) -> str:
    """CTEs trs(t, len), tes(t, mult, len), trg/teg(t, n, g, c)."""
    grams = lambda side: " UNION ALL ".join(
        f"SELECT t, {n} AS n, unnest(list_transform(generate_series(1, len(w) - {n - 1}), "
        f"lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' '))) AS g FROM {side}"
        for n in range(1, 5))
    return f"""
trs AS (SELECT DISTINCT t, {words('t')} AS w FROM ({train_src}) WHERE t IS NOT NULL AND {strip('t')} <> ''),
tes AS (SELECT t, count(*) AS mult, any_value({words('t')}) AS w FROM ({test_src})
        WHERE t IS NOT NULL AND {strip('t')} <> '' GROUP BY t),
trg AS (SELECT t, n, g, count(*) AS c FROM ({grams('trs')}) GROUP BY t, n, g),
teg AS (SELECT t, n, g, count(*) AS c FROM ({grams('tes')}) GROUP BY t, n, g)"""


def bleu_score(m: str, L: str, R: str) -> str:
    """Sentence BLEU expression over columns {m}1..{m}4, {L}, {R}."""
    logs = " + ".join(
        f"ln(CASE WHEN {m}{n} > 0 THEN {m}{n} / greatest(1, {L} - {n - 1}) ELSE 0.1 / greatest(1, {L} - {n - 1}) END)"
        for n in range(1, 5))
    bp = f"CASE WHEN {L} > {R} THEN 1.0 ELSE exp(1.0 - CAST({R} AS DOUBLE) / {L}) END"
    return f"CASE WHEN {m}1 > 0 THEN {bp} * exp(0.25 * ({logs})) ELSE 0.0 END"
