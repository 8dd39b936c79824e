"""DuckDB SQL of template extraction, for the oracles.

The rules are stated over a token table with window functions: noun chunks and
predicate islands are runs found by lag and running sums, spans are joined to
their tokens, and texts are put together by ``string_agg``.  One pass finds
entity spans, a second pass tags the text with entity markers and finds
predicate spans.
"""

from __future__ import annotations

from qtemplates.functions.prefix import STARTER_PAIRS, STARTER_WORDS
from qtemplates.operators import annotate as A
from qtemplates.operators import chunk as CH
from qtemplates.plans import sqlbits as S
from qtemplates.sources.io import DEFAULT_PREFIXES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(xs) -> str:
    return "(" + ", ".join(_q(x) for x in xs) + ")"


def _prefix_end(x: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({x}, {_q(p + ' ')}) OR {x} = {_q(p)} THEN {len(p)}" for p in DEFAULT_PREFIXES) + " END"


def tokens(src: str, p: str, nouns: tuple = ()) -> str:
    """CTEs ``tok<p>`` (one row a token) and ``doc<p>`` (one row a text) of
    ``src`` (k, q); ``nouns``: words that a lexicon adds as nouns."""
    listed = f"WHEN lower(text) IN {_in(nouns)} THEN 'NOUN'" if nouns else ""
    return f"""
cut{p} AS (
  SELECT k, generate_subscripts(t, 1) - 1 AS i, unnest(t) AS text, t, g
  FROM (SELECT k, regexp_extract_all(q, '([\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s])', 1) AS t,
               regexp_split_to_array(q, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]') AS g FROM {src})
),
tag{p} AS (
  SELECT k, i, text, lower(text) AS w,
         CAST(sum(length(g[i + 1]) + CASE WHEN i > 0 THEN length(t[i]) ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS INTEGER) AS idx,
         CASE WHEN NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN 'PUNCT'
              WHEN regexp_matches(text, '^(EC|PC)[0-9]+$') THEN 'PROPN'
              WHEN regexp_matches(text, '^[0-9]+$') THEN 'NUM'
              {listed}
              WHEN lower(text) IN {_in(A.DET)} THEN 'DET' WHEN lower(text) IN {_in(A.ADP)} THEN 'ADP'
              WHEN lower(text) IN {_in(A.PART)} THEN 'PART' WHEN lower(text) IN {_in(A.AUX)} THEN 'AUX'
              WHEN lower(text) IN {_in(A.PRON)} THEN 'PRON' WHEN lower(text) IN {_in(A.CCONJ)} THEN 'CCONJ'
              WHEN lower(text) IN {_in(A.SCONJ)} THEN 'SCONJ'
              WHEN regexp_matches(lower(text), 'ly$') THEN 'ADV'
              WHEN regexp_matches(lower(text), '(al|ive|ous|able|ible|ful|ic)$') THEN 'ADJ'
              WHEN lower(text) IN {_in(A.VERB_WORDS)} OR regexp_matches(lower(text), '(ing|ed|ize|ise)$') THEN 'VERB'
              ELSE 'NOUN' END AS p0
  FROM cut{p}
),
pos{p} AS (
  SELECT k, i, text, w, idx, idx + length(text) AS till,
         CASE WHEN p0 = 'VERB' AND w IN {_in(A.VERB_WORDS)} AND lag(p0) OVER o IN ('DET', 'ADJ') THEN 'NOUN' ELSE p0 END AS pos
  FROM tag{p} WINDOW o AS (PARTITION BY k ORDER BY i)
),
tok{p} AS (
  SELECT *, CASE WHEN pos IN ('AUX', 'PART') THEN CASE WHEN lead(pos, 1) OVER o = 'VERB' THEN i + 1
                 WHEN lead(pos, 2) OVER o = 'VERB' THEN i + 2 WHEN lead(pos, 3) OVER o = 'VERB' THEN i + 3 END END AS head
  FROM pos{p} WINDOW o AS (PARTITION BY k ORDER BY i)
),
doc{p} AS (
  SELECT s.k, s.q, c.n, {_prefix_end('lower(s.q)')} AS pe, c.w0, c.p0, c.p1, c.p2,
         coalesce(c.w0 IN {_in(STARTER_WORDS)}, false) AS one,
         coalesce(c.w0 || ' ' || c.w1 IN {_in([f"{a} {b}" for a, b in STARTER_PAIRS])}, false) AS two
  FROM {src} s LEFT JOIN (
    SELECT k, count(*) AS n, max(CASE WHEN i = 0 THEN w END) AS w0, max(CASE WHEN i = 1 THEN w END) AS w1,
           max(CASE WHEN i = 0 THEN pos END) AS p0, max(CASE WHEN i = 1 THEN pos END) AS p1, max(CASE WHEN i = 2 THEN pos END) AS p2
    FROM tok{p} GROUP BY k) c ON s.k = c.k
)"""


#: Does the range of tokens s..e hold a question starter (only the first two can be)?
_STARTS = "((s <= 0 AND e >= 0 AND (one OR two)) OR (s <= 1 AND e >= 1 AND two))"


def entities(p: str, profile: str) -> str:
    """CTE ``ec`` (k, b, e, kind, v, ord) of all entity spans."""
    reject = _in(CH._profile_lists(profile)[0])
    return f"""
member AS (SELECT *, pos = 'DET' AS isd, pos IN ('DET', 'ADJ', 'NUM', 'NOUN', 'PROPN') AS ism FROM tok{p}),
begun AS (SELECT *, CASE WHEN isd OR (ism AND NOT coalesce(lag(ism) OVER o, false)) THEN 1 ELSE 0 END AS st
          FROM member WINDOW o AS (PARTITION BY k ORDER BY i)),
runs AS (SELECT *, sum(st) OVER (PARTITION BY k ORDER BY i) AS r FROM begun),
chunks AS (SELECT k, min(i) AS s0, max(i) FILTER (pos IN ('NOUN', 'PROPN')) AS e FROM runs WHERE ism GROUP BY k, r),
first_word AS (
  SELECT c.k, s0, c.e, CASE WHEN (c.e - s0 > 0 AND starts_with(t.w, 'wh')) OR t.w = 'how' THEN s0 + 1 ELSE s0 END AS s1
  FROM chunks c JOIN tok{p} t ON t.k = c.k AND t.i = s0 WHERE c.e IS NOT NULL),
quantified AS (
  SELECT c.k, s0, c.e, CASE WHEN s1 <= c.e AND t.w IN {_in(CH.LEADING_QUANTIFIERS)} THEN s1 + 1 ELSE s1 END AS s
  FROM first_word c LEFT JOIN tok{p} t ON t.k = c.k AND t.i = s1),
located AS (
  SELECT c.k, s0, c.s, c.e, a.idx AS b, z.till AS ee, substr(d.q, a.idx + 1, z.till - a.idx) AS txt, d.pe, d.one, d.two, d.w0, d.p0
  FROM quantified c JOIN tok{p} a ON a.k = c.k AND a.i = c.s JOIN tok{p} z ON z.k = c.k AND z.i = c.e JOIN doc{p} d ON d.k = c.k
  WHERE c.s <= c.e),
ec AS (
  SELECT k, b, ee AS e, CASE WHEN contains({S.strip('txt')}, 'the thing') AND ee - b > 9 THEN 2 ELSE 1 END AS kind, txt AS v, 1 AS ord
  FROM located
  WHERE (pe IS NULL OR b >= pe) AND {S.strip('txt')} <> '' AND lower({S.strip('txt')}) NOT IN {reject} AND NOT {_STARTS}
    AND NOT (s0 = 0 AND e = 0 AND p0 IN ('AUX', 'VERB') AND w0 IN {_in(CH.LEADING_AUX)})
  UNION ALL
  SELECT d.k, t.idx, t.till, 1, t.text, 0 FROM doc{p} d JOIN tok{p} t ON t.k = d.k AND t.i = 1
  WHERE d.n > 2 AND d.w0 = 'how' AND d.p1 = 'ADJ' AND d.p2 = 'VERB'
  UNION ALL
  SELECT d.k, t.idx, t.till, 1, t.text, 2
  FROM doc{p} d JOIN tok{p} t ON t.k = d.k AND t.i = d.n - 2 JOIN tok{p} z ON z.k = d.k AND z.i = d.n - 1
  LEFT JOIN tok{p} y ON y.k = d.k AND y.i = d.n - 3
  WHERE z.text = '?' AND (t.pos IN ('ADJ', 'ADV') OR (t.pos = 'VERB' AND y.text IN {_in(CH.FINAL_COPULA)}))
    AND t.w NOT IN {reject} AND NOT ((d.n = 2 AND d.one) OR (d.n <= 3 AND d.two))
)"""


def predicates(p: str, profile: str) -> str:
    """CTE ``pc`` (k, b, e, kind, v, num) of predicate spans and auxiliaries."""
    reject = _in(CH._profile_lists(profile)[1])
    return f"""
verbal AS (SELECT *, pos IN ('PART', 'VERB') AS mem, pos IN ('ADJ', 'ADV') AS isj,
                  CASE WHEN pos IN ('PART', 'VERB') AND NOT coalesce(lag(pos) OVER o IN ('PART', 'VERB'), false) THEN 1 ELSE 0 END AS st
           FROM tok{p} WINDOW o AS (PARTITION BY k ORDER BY i)),
islands AS (SELECT *, sum(st) OVER (PARTITION BY k ORDER BY i) AS r,
                   min(CASE WHEN NOT isj THEN i END) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS past
            FROM verbal),
island AS (SELECT k, min(i) AS s, max(i) AS z, max(i) FILTER (pos = 'VERB') AS lv FROM islands WHERE mem GROUP BY k, r),
ended AS (
  SELECT n.k, n.s, CASE WHEN a.pos = 'ADP' THEN n.z + 1 WHEN a.isj AND f.pos = 'ADP' THEN a.past ELSE n.lv END AS e
  FROM island n LEFT JOIN islands a ON a.k = n.k AND a.i = n.z + 1 LEFT JOIN islands f ON f.k = n.k AND f.i = a.past),
mains AS (
  SELECT n.k, n.s, n.e, a.idx AS b, z.till AS ee, substr(d.q, a.idx + 1, z.till - a.idx) AS txt, d.one, d.two,
         (SELECT max(x.i) FROM tok{p} x WHERE x.k = n.k AND x.head BETWEEN n.s AND n.e AND NOT x.i BETWEEN n.s AND n.e) AS ax, d.pe
  FROM ended n JOIN tok{p} a ON a.k = n.k AND a.i = n.s JOIN tok{p} z ON z.k = n.k AND z.i = n.e JOIN doc{p} d ON d.k = n.k
  WHERE n.e IS NOT NULL),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY s) AS num FROM mains
  WHERE (pe IS NULL OR b >= pe) AND {S.strip('txt')} <> '' AND lower({S.strip('txt')}) NOT IN {reject} AND NOT {_STARTS}),
pc AS (
  SELECT k, b, ee AS e, 1 AS kind, txt AS v, num, 0 AS ord FROM numbered
  UNION ALL
  SELECT n.k, x.idx, x.till, 0, NULL, num, 1 FROM numbered n JOIN tok{p} x ON x.k = n.k AND x.i = n.ax
  WHERE x.w NOT IN {reject} AND NOT ((x.i = 0 AND one) OR (x.i <= 1 AND two))
)"""


def spliced(spans: str, src: str, out: str, prefix: str, renumber: bool) -> str:
    """CTEs ``<out>k`` (kept spans with numbers) and ``<out>`` (k, q): the
    text with markers."""
    num = "1 + coalesce(sum(greatest(kind, 1)) OVER (PARTITION BY k ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)" if renumber else "num"
    return f"""
{out}a AS (SELECT *, coalesce(max(e) OVER (PARTITION BY k ORDER BY b, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM {spans}),
{out}n AS (SELECT k, b, e, kind, v, CAST({num} AS INTEGER) AS num FROM {out}a WHERE b >= upto),
{out}k AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY k ORDER BY b), 0) AS past,
                 '{prefix}' || num || CASE WHEN kind = 2 THEN ' {prefix}' || (num + 1) ELSE '' END AS marker FROM {out}n),
{out} AS (
  SELECT s.k, coalesce(m.head || substr(s.q, m.past + 1), s.q) AS q
  FROM {src} s LEFT JOIN (
    SELECT x.k, string_agg(substr(y.q, x.past + 1, x.b - x.past) || x.marker, '' ORDER BY x.b) AS head, max(x.e) AS past
    FROM {out}k x JOIN {src} y ON y.k = x.k GROUP BY x.k) m ON m.k = s.k)"""


def templates(src: str, profile: str, nouns: tuple = ()) -> str:
    """CTEs up to ``final`` (k, q: the template) and ``entries`` (k, n, key,
    v: the marker map in order) of ``src`` (k, q)."""
    return ",\n".join([tokens(src, "1", nouns).strip(), entities("1", profile).strip(), spliced("ec", src, "marked", "EC", True).strip(),
                       tokens("marked", "2", nouns).strip(), predicates("2", profile).strip(), spliced("pc", "marked", "final", "PC", False).strip(), """
entries AS (
  SELECT k, num AS n, 'EC' || num AS key, CASE WHEN kind = 2 THEN 'the' ELSE v END AS v FROM markedk
  UNION ALL SELECT k, num + 1, 'EC' || (num + 1), 'thing' FROM markedk WHERE kind = 2
  UNION ALL SELECT k, 1000000 + num, 'PC' || num, v FROM finalk WHERE kind = 1),
maps AS (SELECT k, string_agg(key || '=' || v, '; ' ORDER BY n) AS mapping FROM entries GROUP BY k)""".strip()])
