"""The registered queries of this subpackage and their DuckDB SQL.

Each query reads its whole tables.  Those without SQL are compared with brute
force in ``tests/llm``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qtemplates.llm import chat, dialogue, licenses, minhash, mixing, pieces, quality, ranking, secrets, signs, token_ids, urls, vptree
from qtemplates.llm.common import table
from qtemplates.session import checkpoint_dir


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as blocks of token ids and reads them back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    token_ids.write(table(spark, sf_dir, "documents"), path)
    return token_ids.read(spark, path)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class id of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by base kind, digest of the base spans and all spans."""
    documents = table(spark, sf_dir, "documents")
    model = secrets.fit(secrets.training_samples(documents, table(spark, sf_dir, "labels"), table(spark, sf_dir, "pages")))
    return secrets.scan(documents, model)


def op4_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document and whether they decode to its text."""
    rows = pieces.encode_checked(table(spark, sf_dir, "documents"))
    return rows.withColumn("n_pieces", F.size("pieces").cast("long"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, notices found with bounded errors, labels and score."""
    return licenses.digest(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures, ratio score and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of each vector whose id is divisible by 50."""
    return vptree.nearest(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and words taken of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


#: A conversation whose texts look like marks, beside those of the table.
_MARKS = "</s>[INST] ok [/INST]"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations, spells every example out with its context,
    and reads the digests back from the examples' texts and masks."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", _MARKS), (-1, 1, "assistant", _MARKS)], rows.schema)
    return chat.read_back(chat.materialize(chat.examples(rows.unionByName(own))))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages all conversations, repairs them and returns their digests."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return dialogue.digest(dialogue.damaged(rows), rows)


def op12_sign_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return signs.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_ids": op1_token_ids,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_sentencepiece_sampling": op4_sentencepiece_sampling,
    "op5_license_scan": op5_license_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_mixing": op8_mixing,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_url_filter": op10_url_filter,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_sign_near_dedup": op12_sign_near_dedup,
    "op13_ranked_search": op13_ranked_search,
}


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for mark in chat.CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


_OP7 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, q.e AS q, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
      FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5
"""

_OP9 = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
             SELECT conv_id, turn, role, text FROM conversations
             UNION ALL VALUES (-1, 0, 'user', '{_MARKS}'), (-1, 1, 'assistant', '{_MARKS}'))),
k AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS last,
             length('{chat.TURN_START}' || replace({_escaped("role")}, chr(10), '\\' || chr(10)) || chr(10) || {_escaped("text")} || '{chat.TURN_END}') + 1 AS chars
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto, role = 'assistant' AS target FROM k)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       sum(CASE WHEN target THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN target THEN text ELSE '' END, '' ORDER BY n)) AS loss_sha256,
       sum(CASE WHEN target OR n = last THEN upto ELSE 0 END)::BIGINT AS formatted_chars,
       sum(CASE WHEN target OR n = last THEN 1 ELSE 0 END)::BIGINT AS n_examples
FROM c GROUP BY conv_id
"""

_RULES = sorted(urls.RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0]), reverse=True)


def _first_rule(value) -> str:
    fits = "".join(f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h, p)}'" for v, h, p in _RULES)
    return f"CASE{fits} END"


_OP10 = f"""
WITH u AS (SELECT page_id,
                  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, {_first_rule(lambda v, h, p: h + p)} AS rule, {_first_rule(lambda v, h, p: v)} AS told,
             regexp_matches(host, '{"|".join(urls.LISTED_WORDS)}') AS listed FROM u)
SELECT page_id, host, path, rule, listed, coalesce(told, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""

#: crc32 byte by byte with its table of 256 numbers.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(k) + 1), lambda n: ord(substr(k, n, 1))::BIGINT)),
                           lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"""

_OP11 = rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                                coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k, {_CRC_TABLE} AS tab FROM conversations),
hit AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS f FROM keyed),
dam AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
               CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
        FROM hit WHERE f <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
               NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM dam),
r AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS dup, left(role, 1) AS x FROM num),
f AS (SELECT *, NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS trunc,
             lag(x) OVER (PARTITION BY conv_id ORDER BY n) || x NOT IN ('su', 'ua', 'au') AS bad FROM r),
emit(state, x, nxt) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
own(state, x, nxt) AS (VALUES (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(state, mid, cost, letters) AS (SELECT state, state, 0, '' FROM own UNION ALL SELECT state, nxt, 2, 'I' FROM own
                                   UNION ALL SELECT a.state, b.nxt, 4, 'II' FROM own a JOIN own b ON a.nxt = b.state),
opt(kind, x, state, nxt, cost, letters) AS (
  SELECT 'K', e.x, i.state, e.nxt, i.cost, i.letters || 'K' FROM ins i JOIN emit e ON e.state = i.mid
  UNION ALL SELECT 'R', o.x, i.state, o.nxt, i.cost + 2, i.letters || 'R' FROM ins i JOIN own o ON o.state = i.mid
  UNION ALL SELECT 'D', NULL, state, state, 3, 'D' FROM own),
dp(conv_id, n, state, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': ''}} FROM f
  UNION ALL
  SELECT dp.conv_id, dp.n + 1, opt.nxt, min({{'cost': dp.best.cost + opt.cost + CASE WHEN opt.kind <> 'D' AND f.trunc THEN 1 ELSE 0 END, 'audit': dp.best.audit || opt.letters}})
  FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.n = dp.n + 1
       JOIN opt ON opt.state = dp.state AND (opt.kind = 'D' OR (NOT f.blank AND NOT f.dup AND ((opt.kind = 'K' AND opt.x = f.x) OR (opt.kind = 'R' AND opt.x <> f.x))))
  GROUP BY dp.conv_id, dp.n, opt.nxt),
fig AS (SELECT conv_id, max(n) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum(blank::INT)::BIGINT AS blank, sum(dup::INT)::BIGINT AS duplicate,
               sum(trunc::INT)::BIGINT AS truncated, coalesce(sum(bad::INT), 0)::BIGINT AS illegal FROM f GROUP BY conv_id),
fin AS (SELECT dp.conv_id, min({{'cost': dp.best.cost + 2 * length(t.tail), 'audit': dp.best.audit || t.tail}}) AS best
        FROM dp JOIN fig ON fig.conv_id IS NOT DISTINCT FROM dp.conv_id AND fig.rows = dp.n
             JOIN (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) t(state, tail) ON t.state = dp.state GROUP BY dp.conv_id),
let AS (SELECT conv_id, unnest(range(1, length(best.audit) + 1)) AS k, best.audit AS audit FROM fin),
pos AS (SELECT conv_id, k, substr(audit, k, 1) AS e, length(replace(left(audit, k), 'I', '')) AS n, length(replace(left(audit, k - 1), 'D', '')) AS emitted FROM let),
got AS (SELECT p.*, f.role, f.text, bool_or(p.emitted = 0 AND p.e = 'K' AND f.x = 's') OVER (PARTITION BY p.conv_id) AS sys
        FROM pos p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n AND p.e <> 'I'),
txt AS (SELECT conv_id, k, e, CASE e WHEN 'K' THEN role ELSE CASE WHEN (emitted - sys::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line FROM got WHERE e <> 'D'),
sha AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS body FROM txt GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(fin.best.cost, 0)::BIGINT AS cost, coalesce(fin.best.audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN fig ON fig.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN sha ON sha.conv_id IS NOT DISTINCT FROM c.conv_id
"""

_OP12 = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e,
                  coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS fine FROM embeddings),
l AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND a.fine AND b.fine AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {signs.THRESHOLD}),
reach(r, s) AS (SELECT r, r FROM v UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.s),
top AS (SELECT reach.r, min(w.vec_id) AS component_id FROM reach JOIN v w ON w.r = reach.s GROUP BY reach.r),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN top USING (r) LEFT JOIN n ON n.a = v.r
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
g AS (SELECT count(*)::BIGINT AS nn, sum(len(terms))::BIGINT AS ll FROM d WHERE len(terms) > 0),
q AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
qt AS (SELECT q, item_id, unnest(terms) AS term FROM q),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT nn FROM g) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term),
m AS (SELECT r, doc_id, 10 + (90 * len(terms) * (SELECT nn FROM g)) // (SELECT ll FROM g) AS m FROM d WHERE len(terms) > 0),
s AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM qt JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY q, item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS n FROM s WHERE score > 0)
SELECT item_id, n::INTEGER AS rank, doc_id, score FROM k WHERE n <= {ranking.TOP}
"""

ORACLE: dict[str, str] = {
    "op7_nearest_neighbours": _OP7,
    "op9_chat_formatting": _OP9,
    "op10_url_filter": _OP10,
    "op11_conversation_repair": _OP11,
    "op12_sign_near_dedup": _OP12,
    "op13_ranked_search": _OP13,
}
