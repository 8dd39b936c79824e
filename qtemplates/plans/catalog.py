"""Registered queries: one Spark DataFrame builder per operator, plus the
equivalent DuckDB SQL where the operator is SQL-expressible.

Inputs are the driver's test tables: document lines stand in for questions
and templates, benchmark texts for train templates, conversations for
prompt/response pairs, pages for raw HTML, lineitem for synthetic markers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qtemplates.functions import text as T
from qtemplates.operators import coverage as C
from qtemplates.operators import frequency as K
from qtemplates.operators import split as X
from qtemplates.plans import sqlbits as S
from qtemplates.sources.tables import doc_lines, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


# ---------------------------------------------------------------- step 1: text, splits

def _norm_src_spark():
    return F.concat(
    F.lit("  How doesPC"), F.col("l_suppkey").cast("string"), F.lit("e use ec"),
    F.col("l_linenumber").cast("string"), F.lit("  to   PC"), F.col("l_partkey").cast("string"),
    F.lit(" the EC"), F.col("l_orderkey").cast("string"), F.lit("x and pc"),
    F.col("l_linenumber").cast("string"), F.lit("? "))
_NORM_SRC_SQL = ("('  How doesPC' || l_suppkey || 'e use ec' || l_linenumber || '  to   PC' || l_partkey"
                 " || ' the EC' || l_orderkey || 'x and pc' || l_linenumber || '? ')")


@query("normalize_template", sql=f"""
SELECT l_orderkey, l_linenumber, {S.normalize(_NORM_SRC_SQL)} AS normalized_template FROM lineitem
""")
def q_normalize(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", T.normalize_template(_norm_src_spark()).alias("normalized_template"))


@query("first_last_n_words", sql=_with(S.DOC_LINES) + f"""
SELECT doc_id, line_no,
  {S.first_n('line', 5)} AS first_5, {S.first_n('line', 11)} AS first_11,
  {S.last_n('line', 5)} AS last_5, {S.last_n('line', 11)} AS last_11
FROM doc_lines
""")
def q_first_last(spark, sf):
    d = doc_lines(spark, sf)
    return d.select("doc_id", "line_no",
                    T.first_n_words("line", 5).alias("first_5"), T.first_n_words("line", 11).alias("first_11"),
                    T.last_n_words("line", 5).alias("last_5"), T.last_n_words("line", 11).alias("last_11"))


@query("split_hash", sql=f"""
SELECT doc_id, CASE WHEN {S.hash_test('doc_id')} THEN 'test' ELSE 'train' END AS split FROM documents
""")
def q_split_hash(spark, sf):
    return X.split_hash(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("split_exact", sql="""
WITH h AS (SELECT doc_id, md5('42:' || CAST(doc_id AS VARCHAR)) AS hx, CAST(doc_id AS VARCHAR) AS k FROM documents),
r AS (SELECT doc_id, row_number() OVER (ORDER BY hx, k) AS rn, count(*) OVER () AS n FROM h)
SELECT doc_id, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM r
""")
def q_split_exact(spark, sf):
    # a small bucket, so that the histogram path decides the cut
    return X.split_exact(table(spark, sf, "documents").select("doc_id"), "doc_id", bucket_rows=64)


# ---------------------------------------------------------------- step 2: coverage

def _doc_split(spark, sf):
    d = doc_lines(spark, sf).withColumnRenamed("line", "templated_question")
    is_test = X.split_hash_col("doc_id")
    return d.filter(~is_test), d.filter(is_test)


_SPLIT_CTE = f"""
tagged AS (
  SELECT line AS templated_question,
         CASE WHEN {S.hash_test('doc_id')} THEN 'test' ELSE 'train' END AS split
  FROM doc_lines
)"""


def _keys_cte(levels, src="tagged") -> str:
    parts = []
    for mt, n in levels:
        if mt == C.FULL:
            key = "nt"
        elif mt == C.FORWARD:
            key = S.first_n("nt", n)
        else:
            key = S.last_n("nt", n)
        parts.append(f"SELECT split, templated_question, nt, '{mt}' AS match_type, {n} AS n_words, {key} AS key FROM norm")
    return (f"norm AS (SELECT split, templated_question, {S.normalize('templated_question')} AS nt "
            f"FROM {src} WHERE templated_question IS NOT NULL),\n"
            "keys AS (\n  " + "\n  UNION ALL ".join(parts) + "\n)")


def _summary_sql(levels) -> str:
    return _with(S.DOC_LINES, _SPLIT_CTE, _keys_cte(levels), """
train_keys AS (SELECT DISTINCT match_type, n_words, key FROM keys WHERE split = 'train' AND key <> '')""") + """
SELECT t.match_type,
       CAST(CASE WHEN t.match_type = 'full_exact' THEN NULL ELSE t.n_words END AS INTEGER) AS n_words,
       CAST(count(tr.key) AS BIGINT) AS matched, CAST(count(*) AS BIGINT) AS total,
       CASE WHEN count(*) > 0 THEN round_even(100.0 * count(tr.key) / count(*), 2) ELSE 0.0 END AS coverage_pct
FROM keys t LEFT JOIN train_keys tr
  ON t.match_type = tr.match_type AND t.n_words = tr.n_words AND t.key = tr.key
WHERE t.split = 'test'
GROUP BY t.match_type, t.n_words
"""


@query("coverage_exact", sql=_summary_sql(C.level_list((), (), True)))
def q_cov_exact(spark, sf):
    tr, te = _doc_split(spark, sf)
    return C.coverage_exact(tr, te)


@query("coverage_forward", sql=_summary_sql(C.level_list(C.FORWARD_LEVELS, (), False)))
def q_cov_forward(spark, sf):
    tr, te = _doc_split(spark, sf)
    return C.coverage_first_n(tr, te, C.FORWARD_LEVELS)


@query("coverage_backward", sql=_summary_sql(C.level_list((), C.BACKWARD_LEVELS, False)))
def q_cov_backward(spark, sf):
    tr, te = _doc_split(spark, sf)
    return C.coverage_last_n(tr, te, C.BACKWARD_LEVELS)


@query("run_coverage", sql=_summary_sql(C.level_list()))
def q_run_coverage(spark, sf):
    tr, te = _doc_split(spark, sf)
    return C.run_coverage(tr, te)


_MATCH_LEVELS = C.level_list((10, 11), (10, 11), True)


@query("coverage_matches", sql=_with(S.DOC_LINES, _SPLIT_CTE, _keys_cte(_MATCH_LEVELS), """
reps AS (
  SELECT match_type, n_words, key, nt AS matched_train_template FROM (
    SELECT *, row_number() OVER (PARTITION BY match_type, n_words, key
                                 ORDER BY length(templated_question), templated_question) AS rn
    FROM keys WHERE split = 'train' AND key <> '') WHERE rn = 1
)""") + """
SELECT t.templated_question, t.nt AS normalized_template, t.match_type,
       CAST(CASE WHEN t.match_type = 'full_exact' THEN NULL ELSE t.n_words END AS INTEGER) AS n_words,
       t.key, r.matched_train_template
FROM keys t JOIN reps r ON t.match_type = r.match_type AND t.n_words = r.n_words AND t.key = r.key
WHERE t.split = 'test' AND t.key <> ''
""")
def q_cov_matches(spark, sf):
    tr, te = _doc_split(spark, sf)
    return C.coverage_matches(tr, te)


@query("coverage_benchmark_train", sql=_with(S.DOC_LINES, """
tagged AS (
  SELECT text AS templated_question, 'train' AS split FROM benchmark
  UNION ALL SELECT line, 'test' FROM doc_lines
)""", _keys_cte(C.level_list()), """
train_keys AS (SELECT DISTINCT match_type, n_words, key FROM keys WHERE split = 'train' AND key <> '')""") + """
SELECT t.match_type,
       CAST(CASE WHEN t.match_type = 'full_exact' THEN NULL ELSE t.n_words END AS INTEGER) AS n_words,
       CAST(count(tr.key) AS BIGINT) AS matched, CAST(count(*) AS BIGINT) AS total,
       CASE WHEN count(*) > 0 THEN round_even(100.0 * count(tr.key) / count(*), 2) ELSE 0.0 END AS coverage_pct
FROM keys t LEFT JOIN train_keys tr
  ON t.match_type = tr.match_type AND t.n_words = tr.n_words AND t.key = tr.key
WHERE t.split = 'test'
GROUP BY t.match_type, t.n_words
""")
def q_cov_bench(spark, sf):
    tr = table(spark, sf, "benchmark").select(F.col("text").alias("templated_question"))
    te = doc_lines(spark, sf).select(F.col("line").alias("templated_question"))
    return C.run_coverage(tr, te)


# ---------------------------------------------------------------- step 3: frequencies

@query("question_pattern_frequency", sql=_with(S.DOC_LINES) + f"""
SELECT pattern, CAST(count(*) AS BIGINT) AS frequency
FROM (SELECT {S.pattern('line')} AS pattern FROM doc_lines)
WHERE pattern IS NOT NULL GROUP BY pattern HAVING count(*) >= 2
""")
def q_pattern_freq(spark, sf):
    return K.pattern_frequency(doc_lines(spark, sf), "line", 5, 2)


@query("template_frequency", sql=_with(S.DOC_LINES) + f"""
SELECT t AS templated_question, CAST(count(*) AS BIGINT) AS frequency
FROM (SELECT {S.strip('line')} AS t FROM doc_lines) WHERE t <> '' GROUP BY t
""")
def q_template_freq(spark, sf):
    d = doc_lines(spark, sf).select(F.col("line").alias("templated_question"))
    return K.template_frequency(d)


def _marker_frame(spark, sf) -> DataFrame:
    """Wide marker table from document lines: word i of the line is marker i
    (EC1..EC5 = words 1-5, PC1, PC2 = words 6, 7), missing -> null."""
    w = T.py_split("line")
    d = doc_lines(spark, sf)
    cols = [F.try_element_at(w, F.lit(i + 1)).alias(m) for i, m in enumerate(K.DEFAULT_MARKERS)]
    return d.select(*cols)


_MARKER_CTE = "markers AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT '{m}' AS marker, {S.words('line')}[{i + 1}] AS value FROM doc_lines"
    for i, m in enumerate(K.DEFAULT_MARKERS)) + "\n)"
_CHUNK_COUNTS = f"""
counts AS (
  SELECT marker, chunk, CAST(count(*) AS BIGINT) AS frequency FROM (
    SELECT marker, lower({S.strip('value')}) AS chunk FROM markers WHERE value IS NOT NULL)
  WHERE chunk <> '' GROUP BY marker, chunk HAVING count(*) >= 2
),
ranked AS (
  SELECT marker, CAST(row_number() OVER (PARTITION BY marker ORDER BY frequency DESC, chunk) AS BIGINT) AS rank,
         chunk, frequency FROM counts
)"""


@query("chunk_frequency", sql=_with(S.DOC_LINES, _MARKER_CTE, _CHUNK_COUNTS) + "SELECT * FROM ranked")
def q_chunk_freq(spark, sf):
    return K.chunk_frequency(_marker_frame(spark, sf))


@query("chunk_table", sql=_with(S.DOC_LINES, _MARKER_CTE, _CHUNK_COUNTS) + "SELECT rank, " + ", ".join(
    f"coalesce(max(CASE WHEN marker = '{m}' THEN chunk END), '') AS \"{m} chunks\", "
    f"coalesce(CAST(max(CASE WHEN marker = '{m}' THEN frequency END) AS VARCHAR), '') AS \"{m} frequency\""
    for m in K.DEFAULT_MARKERS) + " FROM ranked GROUP BY rank")
def q_chunk_table(spark, sf):
    return K.chunk_table(_marker_frame(spark, sf))


@query("top_k_templates", sql=_with(S.DOC_LINES) + f"""
SELECT templated_question, frequency FROM (
  SELECT t AS templated_question, CAST(count(*) AS BIGINT) AS frequency
  FROM (SELECT {S.strip('line')} AS t FROM doc_lines) WHERE t <> '' GROUP BY t)
ORDER BY frequency DESC, templated_question LIMIT 20
""")
def q_top_k(spark, sf):
    d = doc_lines(spark, sf).select(F.col("line").alias("templated_question"))
    return K.top_k(K.template_frequency(d), 20, [F.desc("frequency"), F.col("templated_question")])


# ---------------------------------------------------------------- step 4: BLEU

from qtemplates.operators import best_bleu as BB  # noqa: E402
from qtemplates.operators import bleu as B  # noqa: E402
from qtemplates.sources.tables import bench_lines  # noqa: E402

_BLEU_SRC = (S.BENCH_LINES, "SELECT line AS t FROM bench_lines", "SELECT line AS t FROM doc_lines")


def _bleu_inputs(spark, sf):
    tr = bench_lines(spark, sf).select(F.col("line").alias("template"))
    te = doc_lines(spark, sf).select(F.col("line").alias("template"))
    return tr, te


_PAIR_SCORES = """
pairs AS (
  SELECT a.t AS te, b.t AS tr,
         sum(CASE WHEN a.n = 1 THEN least(a.c, b.c) ELSE 0 END) AS m1,
         sum(CASE WHEN a.n = 2 THEN least(a.c, b.c) ELSE 0 END) AS m2,
         sum(CASE WHEN a.n = 3 THEN least(a.c, b.c) ELSE 0 END) AS m3,
         sum(CASE WHEN a.n = 4 THEN least(a.c, b.c) ELSE 0 END) AS m4
  FROM teg a JOIN trg b ON a.n = b.n AND a.g = b.g GROUP BY a.t, b.t
),
scored AS (
  SELECT p.te, {score} AS s
  FROM pairs p JOIN tes ON tes.t = p.te JOIN trs ON trs.t = p.tr
),
best AS (
  SELECT tes.t AS template, CAST(tes.mult AS BIGINT) AS mult, coalesce(max(s), 0.0) AS bleu
  FROM tes LEFT JOIN scored ON scored.te = tes.t GROUP BY tes.t, tes.mult
)""".replace("{score}", S.bleu_score("p.m", "len(tes.w)", "len(trs.w)"))


# Best-match BLEU is a top-1 search over all train sentences; it runs on the
# benchmark sentences split 80/20 by hash (whole table, both sides).
_BENCH_KEY_SQL = "CAST(item_id AS VARCHAR) || ':' || CAST(line_no AS VARCHAR)"
_BENCH_SPLIT = (S.BENCH_LINES,
                f"SELECT line AS t FROM bench_lines WHERE NOT {S.hash_test(_BENCH_KEY_SQL)}",
                f"SELECT line AS t FROM bench_lines WHERE {S.hash_test(_BENCH_KEY_SQL)}")


def _bench_split(spark, sf):
    b = bench_lines(spark, sf)
    key = F.concat(F.col("item_id").cast("string"), F.lit(":"), F.col("line_no").cast("string"))
    is_test = X.split_hash_col(key)
    return (b.filter(~is_test).select(F.col("line").alias("template")),
            b.filter(is_test).select(F.col("line").alias("template")))


@query("max_sentence_bleu", sql=_with(_BENCH_SPLIT[0], S.bleu_sides(*_BENCH_SPLIT[1:]), _PAIR_SCORES)
       + "SELECT template, mult, round(bleu, 9) AS bleu FROM best")
def q_max_bleu(spark, sf):
    tr, te = _bench_split(spark, sf)
    b = B.max_sentence_bleu(tr, te)
    return b.select("template", "mult", F.round("bleu", 9).alias("bleu"))


@query("average_bleu", sql=_with(_BENCH_SPLIT[0], S.bleu_sides(*_BENCH_SPLIT[1:]), _PAIR_SCORES)
       + "SELECT round(coalesce(sum(bleu * mult) / sum(mult), 0.0), 9) AS average_bleu FROM best")
def q_avg_bleu(spark, sf):
    tr, te = _bench_split(spark, sf)
    a = B.average_bleu(B.max_sentence_bleu(tr, te))
    return a.select(F.round("average_bleu", 9).alias("average_bleu"))


@query("best_bleu_document_lines", sql=_with(S.DOC_LINES, _BLEU_SRC[0], S.bleu_sides(*_BLEU_SRC[1:]), _PAIR_SCORES)
       + "SELECT template, mult, round(bleu, 9) AS bleu FROM best")
def q_best_bleu_lines(spark, sf):
    """B1 with all document lines as test side, benchmark lines as train side."""
    tr, te = _bleu_inputs(spark, sf)
    best, _ = BB.best_sentence_bleu(tr, te)
    return best.select("template", "mult", F.round("bleu", 9).alias("bleu"))


_CORPUS = """
maxref AS (SELECT n, g, max(c) AS mc FROM trg GROUP BY n, g),
nums AS (
  SELECT sum(CASE WHEN h.n = 1 THEN tes.mult * least(h.c, coalesce(r.mc, 0)) ELSE 0 END) AS m1,
         sum(CASE WHEN h.n = 2 THEN tes.mult * least(h.c, coalesce(r.mc, 0)) ELSE 0 END) AS m2,
         sum(CASE WHEN h.n = 3 THEN tes.mult * least(h.c, coalesce(r.mc, 0)) ELSE 0 END) AS m3,
         sum(CASE WHEN h.n = 4 THEN tes.mult * least(h.c, coalesce(r.mc, 0)) ELSE 0 END) AS m4
  FROM teg h JOIN tes ON tes.t = h.t LEFT JOIN maxref r ON r.n = h.n AND r.g = h.g
),
rl AS (SELECT DISTINCT len(w) AS R FROM trs),
hl AS (SELECT len(w) AS L, sum(mult) AS w FROM tes GROUP BY len(w)),
closest AS (
  SELECT L, w, (SELECT R FROM rl ORDER BY abs(R - L), R LIMIT 1) AS R FROM hl
),
tot AS (
  SELECT sum(w * L) AS hyp_len, sum(w * R) AS ref_len,
         sum(w * greatest(1, L)) AS d1, sum(w * greatest(1, L - 1)) AS d2,
         sum(w * greatest(1, L - 2)) AS d3, sum(w * greatest(1, L - 3)) AS d4
  FROM closest
)"""


@query("corpus_bleu", sql=_with(S.DOC_LINES, _BLEU_SRC[0], S.bleu_sides(*_BLEU_SRC[1:]), _CORPUS) + """
SELECT round(coalesce(CASE WHEN m1 > 0 THEN
  (CASE WHEN hyp_len > ref_len THEN 1.0 WHEN hyp_len = 0 THEN 0.0 ELSE exp(1.0 - CAST(ref_len AS DOUBLE) / hyp_len) END)
  * exp(0.25 * (ln(CASE WHEN m1 > 0 THEN m1 / d1 ELSE 0.1 / d1 END) + ln(CASE WHEN m2 > 0 THEN m2 / d2 ELSE 0.1 / d2 END)
              + ln(CASE WHEN m3 > 0 THEN m3 / d3 ELSE 0.1 / d3 END) + ln(CASE WHEN m4 > 0 THEN m4 / d4 ELSE 0.1 / d4 END)))
  ELSE 0.0 END, 0.0), 9) AS corpus_bleu
FROM tot, nums
""")
def q_corpus_bleu(spark, sf):
    tr, te = _bleu_inputs(spark, sf)
    return B.corpus_bleu(tr, te).select(F.round("corpus_bleu", 9).alias("corpus_bleu"))


# ---------------------------------------------------------------- step 6: generation jobs

from qtemplates.operators import generate as G  # noqa: E402
from qtemplates.sources import io as IO  # noqa: E402
from qtemplates.sources import pages as H  # noqa: E402
from qtemplates.session import checkpoint_dir  # noqa: E402

# Our own prompt text with one {abstract} slot.
PROMPT = ("Write two research questions about the abstract below, one per line, "
          "without numbering or explanations.\n\nAbstract:\n{abstract}\n")


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("render_prompt", sql=f"""
SELECT doc_id, replace({_sql_str(PROMPT)}, '{{abstract}}', {S.strip('text')}) AS prompt FROM documents
""")
def q_render_prompt(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return G.render_prompt(d, PROMPT, {"abstract": "text"}).select("doc_id", "prompt")


_TURNS_SQL = """
turns AS (
  SELECT u.conv_id, u.turn, u.text AS prompt, u.text || a.text AS generated_text
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""


def _turns(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    # the model output echoes the prompt, as causal LMs do
    return u.join(a, ["conv_id", "turn"]).select(
        "conv_id", "turn", "prompt", F.concat("prompt", "answer").alias("generated_text"))


@query("strip_echo", sql=_with(_TURNS_SQL) + f"""
SELECT conv_id, turn, {S.strip('substr(generated_text, length(prompt) + 1)')} AS response FROM turns
""")
def q_strip_echo(spark, sf):
    return G.strip_echo(_turns(spark, sf)).select("conv_id", "turn", "response")


def _clean_sql(numbering: str) -> str:
    punct = "[.)]" if numbering == "strict" else "[.)]?"
    return _with(_TURNS_SQL, f"""
resp AS (SELECT conv_id, turn, {S.strip('substr(generated_text, length(prompt) + 1)')} AS response FROM turns),
lines AS (
  SELECT conv_id, turn, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS line
  FROM (SELECT conv_id, turn, string_split(response, chr(10)) AS s FROM resp)
)""") + f"""
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, q AS research_question, 'conv:' || conv_id AS url FROM (
  SELECT *, trim(regexp_replace(line, '^\\s*["'']?\\d+{punct}\\s*', ''), ' "''' || chr(10)) AS q FROM lines)
WHERE q <> ''
"""


def _clean_spark(spark, sf, numbering):
    d = G.strip_echo(_turns(spark, sf))
    d = G.explode_lines(d.withColumn("url", F.concat(F.lit("conv:"), F.col("conv_id").cast("string"))), "response")
    return G.questions(d, "line", numbering).select("conv_id", "turn", "pos", "research_question", "url")


@query("explode_clean_lines_strict", sql=_clean_sql("strict"))
def q_clean_strict(spark, sf):
    return _clean_spark(spark, sf, "strict")


@query("explode_clean_lines_loose", sql=_clean_sql("loose"))
def q_clean_loose(spark, sf):
    return _clean_spark(spark, sf, "loose")


@query("id_range_filter", sql="SELECT doc_id, source FROM documents WHERE doc_id BETWEEN 1 AND 2500")
def q_id_range(spark, sf):
    return G.id_range_filter(table(spark, sf, "documents").select("doc_id", "source"), 1, 2500, "doc_id")


@query("drop_blank", sql=_with(S.DOC_LINES) + "SELECT doc_id, line_no FROM doc_lines")
def q_drop_blank(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return G.drop_blank(d, "line").select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query("dedup_questions", sql=_with(S.DOC_LINES) + "SELECT DISTINCT line AS research_question FROM doc_lines")
def q_dedup(spark, sf):
    return G.dedup_questions(doc_lines(spark, sf).withColumnRenamed("line", "research_question"))


def _echo_model():
    """Stand-in model: echoes the prompt and answers with the abstract's
    sentences as a numbered list (deterministic, so results are checkable)."""
    import re

    def gen(prompts):
        out = []
        for p in prompts:
            body = p.split("Abstract:\n", 1)[-1]
            sents = [s.strip() for s in re.split(r"(?<=[.!?])\s+", body) if s.strip()]
            out.append(p + "\n" + "\n".join(f"{i + 1}. {s}" for i, s in enumerate(sents)))
        return out
    return gen


@query("generate_questions")
def q_generate(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("abstract"),
                                             F.col("source").alias("url"))
    return G.questions_from_abstracts(d, PROMPT, _echo_model, id_col="id")


@query("combine_abstracts", sql="""
SELECT CAST(row_number() OVER (ORDER BY source, doc_id) AS BIGINT) AS id, doc_id AS source_id, source
FROM documents
""")
def q_combine(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    parts = [d.filter(F.col("source") == s) for s in ("src0", "src1", "src2")]
    parts.append(d.filter(~F.coalesce(F.col("source").isin("src0", "src1", "src2"), F.lit(False))))
    out = G.combine_abstracts(parts, [F.col("source"), F.col("source_id")])
    return out.select("id", "source_id", "source")


# ---------------------------------------------------------------- round trips through files

def _scratch(spark, name: str) -> str:
    import uuid
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("questions_csv_roundtrip", sql=_with(S.DOC_LINES) + """
SELECT 'doc:' || doc_id AS url, '  ' || line || chr(9) AS research_question FROM doc_lines""")
def q_csv_roundtrip(spark, sf):
    d = doc_lines(spark, sf).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"),
                                    F.concat(F.lit("  "), F.col("line"), F.lit("\t")).alias("research_question"))  # edges must survive
    path = _scratch(spark, "questions-csv")
    IO.write_csv(d, path)
    return IO.read_questions(spark, path, na="none")


@query("abstracts_json_roundtrip", sql="""
SELECT doc_id AS id, source AS title, text AS abstract, 'doc:' || doc_id AS url FROM documents""")
def q_json_roundtrip(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"),
                                             F.col("text").alias("abstract"),
                                             F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"))
    path = _scratch(spark, "abstracts-json")
    IO.write_abstracts(d, path)
    return IO.read_abstracts(spark, path, json_array=False)


# ---------------------------------------------------------------- step 7: pages

# The tables' pages hold these references and no others; the operators decode all.
_REFS = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "\u00b7"), ("&copy;", "\u00a9"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def _decoded(x: str) -> str:
    for ref, c in _REFS:
        x = f"replace({x}, '{ref}', '{c}')"
    return x


# Pages cut at "<" instead of matched: each piece starts with a tag's name.
_LINKS_SQL = f"""
cut AS (SELECT page_id, url, string_split(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '<') AS p FROM pages),
tags AS (SELECT page_id, url, generate_subscripts(p, 1) AS k, unnest(p) AS piece FROM cut),
atags AS (SELECT *, split_part(piece, '>', 1) AS body FROM tags WHERE lower(left(piece, 2)) = 'a '),
hrefs AS (SELECT *, {_decoded("split_part(split_part(body, 'href=\"', 2), '\"', 1)")} AS href FROM atags WHERE contains(body, ' href="')),
links AS (SELECT url, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, href FROM hrefs)"""


@query("extract_links", sql=_with(_LINKS_SQL) + "SELECT url, CAST(pos AS INTEGER) AS pos, href FROM links")
def q_links(spark, sf):
    return H.extract_links(table(spark, sf, "pages"))


@query("filter_links", sql=_with(_LINKS_SQL) + """
SELECT url, CAST(pos AS INTEGER) AS pos, href FROM links WHERE starts_with(href, '/') AND ends_with(href, '.')""")
def q_filter_links(spark, sf):
    return H.filter_links(H.extract_links(table(spark, sf, "pages")), "/", ".")


@query("distinct_links", sql=_with(_LINKS_SQL) + """
SELECT DISTINCT regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) || href AS link
FROM links WHERE starts_with(href, '/')""")
def q_distinct_links(spark, sf):
    lk = H.filter_links(H.extract_links(table(spark, sf, "pages")), "/", "")
    return H.distinct_links(H.absolutize(lk, H.site_base("url")), "link")


def _flat_sql(tag: str) -> str:
    """Elements by cutting at the opening and closing tags."""
    text = _decoded("regexp_replace(split_part(piece, '</" + tag + ">', 1), '<[^>]*>', '', 'g')")
    return f"""
SELECT page_id, url, CAST(k - 2 AS INTEGER) AS pos, regexp_replace({text}, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g') AS text
FROM (SELECT page_id, url, generate_subscripts(p, 1) AS k, unnest(p) AS piece FROM (
        SELECT page_id, url, string_split_regex(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '<{tag}( [^>]*)?>') AS p FROM pages))
WHERE k > 1"""


def _elements_sql(tag: str) -> str:
    return f"SELECT url, pos, text FROM ({_flat_sql(tag)})"


@query("page_titles", sql=_elements_sql("title"))
def q_titles(spark, sf):
    return H.flat_elements(table(spark, sf, "pages"), "title").select("url", "pos", "text")


@query("page_headings", sql=_elements_sql("h1"))
def q_headings(spark, sf):
    return H.flat_elements(table(spark, sf, "pages"), "h1").select("url", "pos", "text")


@query("zip_elements", sql=f"""
WITH t AS ({_flat_sql('title')}), h AS ({_flat_sql('h1')})
SELECT t.url, t.pos, t.text AS text_a, h.text AS text_b FROM t JOIN h ON t.page_id = h.page_id AND t.pos = h.pos""")
def q_zip(spark, sf):
    return H.zip_elements(table(spark, sf, "pages"), "title", "h1")


@query("assign_ids", sql="""
SELECT CAST(row_number() OVER (ORDER BY url, page_id) AS BIGINT) AS id, page_id FROM pages""")
def q_assign_ids(spark, sf):
    from qtemplates.operators.ids import assign_ids
    p = table(spark, sf, "pages").select("page_id", "url")
    return assign_ids(p, ["url", "page_id"]).select("id", "page_id")


@query("page_articles", sql=_elements_sql("article"))
def q_articles(spark, sf):
    """Nested markup: descendant text of every <article> (html.parser)."""
    return H.extract_elements(spread(table(spark, sf, "pages")), "article").select("url", "pos", "text")


# ---------------------------------------------------------------- step 5: prefixes, annotation, chunking

from qtemplates.functions import prefix as PF  # noqa: E402
from qtemplates.plans import workflows as W  # noqa: E402
from qtemplates.operators import annotate as A  # noqa: E402
from qtemplates.operators import chunk as CH  # noqa: E402


def _questions(spark, sf):
    d = doc_lines(spark, sf)
    return d.select("doc_id", "line_no", T.py_strip("line").alias("q"))


_Q_SQL = f"all_q AS (SELECT doc_id, line_no, {S.strip('line')} AS q FROM doc_lines)"


def _prefix_case(x: str) -> str:
    whens = " ".join(f"WHEN starts_with({x}, {_sql_str(p + ' ')}) OR {x} = {_sql_str(p)} THEN {len(p)}"
                     for p in IO.DEFAULT_PREFIXES)
    return f"CAST(CASE {whens} END AS INTEGER)"


@query("prefix_end", sql=_with(S.DOC_LINES, _Q_SQL) + f"""
SELECT doc_id, line_no, {_prefix_case('lower(q)')} AS prefix_end FROM all_q""")
def q_prefix_end(spark, sf):
    e = _questions(spark, sf)
    return e.select("doc_id", "line_no", PF.prefix_end(F.col("q"), IO.DEFAULT_PREFIXES, stripped=True).alias("prefix_end"))


def _in(xs) -> str:
    return "(" + ", ".join(_sql_str(x) for x in xs) + ")"


_TOKENS_SQL = f"""
tk AS (
  SELECT doc_id, line_no, q, t, g, generate_subscripts(t, 1) - 1 AS i, unnest(t) AS text
  FROM (SELECT doc_id, line_no, q,
               regexp_extract_all(q, '([\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s])', 1) AS t,
               regexp_split_to_array(q, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]') AS g
        FROM all_q)
),
tk0 AS (
  SELECT doc_id, line_no, i, text,
         CAST(sum(length(g[i + 1]) + CASE WHEN i > 0 THEN length(t[i]) ELSE 0 END)
              OVER (PARTITION BY doc_id, line_no ORDER BY i) AS INTEGER) AS idx,
         CASE WHEN NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN 'PUNCT'
              WHEN regexp_matches(text, '^(EC|PC)[0-9]+$') THEN 'PROPN'
              WHEN regexp_matches(text, '^[0-9]+$') THEN 'NUM'
              WHEN lower(text) IN {_in(A.DET)} THEN 'DET'
              WHEN lower(text) IN {_in(A.ADP)} THEN 'ADP'
              WHEN lower(text) IN {_in(A.PART)} THEN 'PART'
              WHEN lower(text) IN {_in(A.AUX)} THEN 'AUX'
              WHEN lower(text) IN {_in(A.PRON)} THEN 'PRON'
              WHEN lower(text) IN {_in(A.CCONJ)} THEN 'CCONJ'
              WHEN lower(text) IN {_in(A.SCONJ)} THEN 'SCONJ'
              WHEN regexp_matches(lower(text), 'ly$') THEN 'ADV'
              WHEN regexp_matches(lower(text), '(al|ive|ous|able|ible|ful|ic)$') THEN 'ADJ'
              WHEN lower(text) IN {_in(A.VERB_WORDS)} OR regexp_matches(lower(text), '(ing|ed|ize|ise)$') THEN 'VERB'
              ELSE 'NOUN' END AS p0
  FROM tk
),
tok AS (
  SELECT doc_id, line_no, i, idx, text,
         CASE WHEN p0 = 'VERB' AND lower(text) IN {_in(A.VERB_WORDS)}
                   AND lag(p0) OVER w IN ('DET', 'ADJ') THEN 'NOUN' ELSE p0 END AS pos
  FROM tk0 WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY i)
),
tokd AS (
  SELECT *, CASE WHEN pos IN ('AUX', 'PART') THEN
              CASE WHEN lead(pos, 1) OVER w = 'VERB' THEN i + 1 WHEN lead(pos, 2) OVER w = 'VERB' THEN i + 2
                   WHEN lead(pos, 3) OVER w = 'VERB' THEN i + 3 END END AS h
  FROM tok WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY i)
)"""


@query("annotate_tokens", sql=_with(S.DOC_LINES, _Q_SQL, _TOKENS_SQL) + """
SELECT doc_id, line_no, CAST(i AS INTEGER) AS i, idx, text, pos,
       CASE WHEN h IS NOT NULL THEN 'aux' ELSE '' END AS dep, CAST(coalesce(h, i) AS INTEGER) AS head
FROM tokd""")
def q_annotate(spark, sf):
    e = _questions(spark, sf)
    return (e.select("doc_id", "line_no", F.explode(A.lexicon_tokens(F.col("q"))).alias("t"))
             .select("doc_id", "line_no", "t.*"))


_ISLANDS_SQL = """
flags AS (
  SELECT *, pos IN ('PART', 'VERB') AS mem, pos IN ('ADJ', 'ADV') AS isj,
         CASE WHEN pos IN ('PART', 'VERB') AND coalesce(lag(pos) OVER w NOT IN ('PART', 'VERB'), true)
              THEN 1 ELSE 0 END AS st
  FROM tok WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY i)
),
ids AS (
  SELECT *, sum(st) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS isl,
         min(CASE WHEN NOT (pos IN ('ADJ', 'ADV')) THEN i END)
           OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_nonj
  FROM flags
),
isl AS (
  SELECT doc_id, line_no, isl, min(i) AS s, max(i) AS e_isl, max(CASE WHEN pos = 'VERB' THEN i END) AS lv
  FROM ids WHERE mem GROUP BY doc_id, line_no, isl
),
tail AS (
  SELECT isl.*, a.pos AS pos1, a.isj AS j1, a.next_nonj, b.pos AS posk
  FROM isl
  LEFT JOIN ids a ON a.doc_id = isl.doc_id AND a.line_no = isl.line_no AND a.i = isl.e_isl + 1
  LEFT JOIN ids b ON b.doc_id = isl.doc_id AND b.line_no = isl.line_no AND b.i = a.next_nonj
)"""


@query("pc_islands", sql=_with(S.DOC_LINES, _Q_SQL, _TOKENS_SQL, _ISLANDS_SQL) + """
SELECT doc_id, line_no, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e FROM (
  SELECT doc_id, line_no, s,
         CASE WHEN pos1 = 'ADP' THEN e_isl + 1
              WHEN j1 AND posk = 'ADP' THEN next_nonj
              ELSE lv END AS e
  FROM tail) WHERE e IS NOT NULL""")
def q_islands(spark, sf):
    e = _questions(spark, sf)
    t = e.select("doc_id", "line_no", A.parsed(F.col("q")).alias("p"))
    return (t.select("doc_id", "line_no", F.explode(CH.pc_islands(F.col("p.tokens"), F.col("p.tags"))).alias("sp"))
             .select("doc_id", "line_no", "sp.s", "sp.e"))


from qtemplates.plans import extraction_sql as XS  # noqa: E402

_KEYED = _with(S.DOC_LINES, _Q_SQL, "keyed AS (SELECT doc_id || ':' || line_no AS k, doc_id, line_no, q FROM all_q)")
# each distinct text once: the rules are row-local
_TEXTS = _KEYED.rstrip() + ",\nsrc AS (SELECT DISTINCT md5(q) AS k, q FROM keyed),\n"


def _map_text(col: str = "mapping"):
    """The marker map in order, as text."""
    return F.array_join(F.transform(F.map_entries(col), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")


@query("ec_spans", sql=_TEXTS + XS.tokens("src", "1").strip() + "," + XS.entities("1", "mapping") + """
SELECT x.doc_id, x.line_no, CAST(ec.b AS INTEGER) AS b, CAST(ec.e AS INTEGER) AS e, CAST(ec.kind AS INTEGER) AS kind, ec.v
FROM keyed x JOIN ec ON ec.k = md5(x.q)""")
def q_ec_spans(spark, sf):
    e = A.annotate(_questions(spark, sf), "q")
    sp = CH.ec_spans(F.col("q"), F.col("tokens"), F.col("noun_chunks"),
                     PF.prefix_end(F.col("q"), IO.DEFAULT_PREFIXES, stripped=True), "mapping")
    return e.select("doc_id", "line_no", F.explode(sp).alias("s")).select("doc_id", "line_no", "s.b", "s.e", "s.kind", "s.v")


@query("extract_template", sql=_TEXTS + XS.templates("src", "fast") + """
SELECT x.doc_id, x.line_no, f.q AS templated_question FROM keyed x JOIN final f ON f.k = md5(x.q)""")
def q_extract_template(spark, sf):
    e = _questions(spark, sf).withColumnRenamed("q", "research_question")
    return CH.extract_template(e).select("doc_id", "line_no", "templated_question")


@query("extract_template_with_mapping", sql=_TEXTS + XS.templates("src", "mapping") + """
SELECT x.doc_id, x.line_no, f.q AS templated_question, coalesce(m.mapping, '') AS mapping
FROM keyed x JOIN final f ON f.k = md5(x.q) LEFT JOIN maps m ON m.k = f.k""")
def q_extract_mapping(spark, sf):
    e = _questions(spark, sf).withColumnRenamed("q", "research_question")
    return CH.extract_template_with_mapping(e).select("doc_id", "line_no", "templated_question", _map_text().alias("mapping"))


_WIDE = ("SELECT s.q AS research_question, f.q AS templated_question, "
         + ", ".join(f"coalesce(max(CASE WHEN e.key = '{m}{i}' THEN e.v END), '') AS {m}{i}" for m, n in (("EC", 5), ("PC", 2)) for i in range(1, n + 1))
         + " FROM src s JOIN final f ON f.k = s.k LEFT JOIN entries e ON e.k = s.k GROUP BY s.q, f.q")


@query("templates_from_questions", sql=_TEXTS + XS.templates("src", "mapping") + "\n" + _WIDE)
def q_templates(spark, sf):
    e = _questions(spark, sf).withColumnRenamed("q", "research_question")
    return CH.wide_templates(CH.templates_from_questions(e))


# ---------------------------------------------------------------- streaming

from qtemplates.streaming import stream as ST  # noqa: E402


@query("stream_pattern_frequency", sql=ORACLE["question_pattern_frequency"])
def q_stream_patterns(spark, sf):
    """Pattern counts over the documents table read as a file stream."""
    return ST.run_pattern_stream(spark, f"{sf.rstrip('/')}/documents*.parquet",
                                 "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")


_DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def _doc_stream(spark, sf, rows, merge) -> DataFrame:
    from qtemplates.streaming import state as SS
    return SS.run_stream(spark, f"{sf.rstrip('/')}/documents*.parquet", _DOC_SCHEMA, rows, merge, files_per_trigger=4)


@query("stream_dedup_questions", sql=_with(S.DOC_LINES) + """
SELECT line AS research_question, min({'d': doc_id, 'l': line_no}).d AS doc_id, min({'d': doc_id, 'l': line_no}).l AS line_no FROM doc_lines GROUP BY line""")
def q_stream_dedup(spark, sf):
    """F4 over the documents table as a file stream."""
    from qtemplates.streaming import state as SS
    kept = _doc_stream(spark, sf, SS.stream_questions, SS.first_questions)
    return kept.select("research_question", "place.doc_id", F.col("place.line_no").cast("long").alias("line_no"))


@query("stream_lookup", sql=_with(S.DOC_LINES, f"""
norm AS (SELECT doc_id, line_no, {S.normalize('line')} AS nt FROM doc_lines),
k AS (SELECT doc_id, line_no, nt, n, {S.words('nt')} AS w FROM norm, (VALUES (5), (10)) v(n))""") + """
SELECT n AS n_words, array_to_string(list_slice(w, 1, n), ' ') AS key, min({'d': doc_id, 'l': line_no, 'nt': nt}).nt AS matched_train_template
FROM k WHERE len(w) > 0 GROUP BY ALL""")
def q_stream_lookup(spark, sf):
    """J1 over the documents table as a file stream."""
    from qtemplates.streaming import state as SS
    levels = C.level_list((5, 10), (), False)
    kept = _doc_stream(spark, sf, lambda b: SS.stream_lookup(b, levels), SS.first_templates)
    return kept.select("n_words", "key", F.col("norm").alias("matched_train_template"))


@query("stream_coverage", sql=ORACLE["run_coverage"])
def q_stream_coverage(spark, sf):
    """J7 over the documents table as a file stream."""
    from qtemplates.streaming import state as SS
    return C.summary(_doc_stream(spark, sf, SS.stream_coverage, C.covered_keys))


# ---------------------------------------------------------------- more of SURVEY 2.1 / 2.7 / E5

@query("template_pairs", sql=_with(S.DOC_LINES, _SPLIT_CTE) + "SELECT split, templated_question AS template FROM tagged")
def q_template_pairs(spark, sf):
    tr, te = _doc_split(spark, sf)
    return B.template_pairs(tr, te, "templated_question")


@query("null_if_na", sql=_with(S.DOC_LINES) + f"""
SELECT doc_id, line_no, CASE WHEN w IN {_in(T.PANDAS_NA_VALUES)} THEN NULL ELSE w END AS first_word
FROM (SELECT doc_id, line_no, {S.words('line')}[1] AS w FROM doc_lines)""")
def q_null_if_na(spark, sf):
    d = doc_lines(spark, sf)
    return d.select("doc_id", "line_no", T.null_if_na(F.get(T.py_split("line"), 0)).alias("first_word"))


@query("coverage_custom_key", sql=_with(S.DOC_LINES, _SPLIT_CTE, f"""
k AS (SELECT split, lower({S.first_n(S.normalize('templated_question'), 3)}) AS key FROM tagged),
tr AS (SELECT DISTINCT key FROM k WHERE split = 'train' AND key <> '')""") + """
SELECT 'first3_lower' AS match_type, CAST(NULL AS INTEGER) AS n_words, CAST(count(tr.key) AS BIGINT) AS matched,
       CAST(count(*) AS BIGINT) AS total,
       CASE WHEN count(*) > 0 THEN round_even(100.0 * count(tr.key) / count(*), 2) ELSE 0.0 END AS coverage_pct
FROM k LEFT JOIN tr ON k.key = tr.key WHERE k.split = 'test'""")
def q_cov_custom(spark, sf):
    tr, te = _doc_split(spark, sf)
    return C.coverage(tr, te, lambda c: F.lower(T.first_n_words(c, 3)), name="first3_lower")


@query("prefix_end_from_patterns", sql=_with(S.DOC_LINES, _Q_SQL, f"""
pats AS (
  SELECT pattern, row_number() OVER (ORDER BY frequency DESC, pattern) AS rk FROM (
    SELECT pattern, count(*) AS frequency FROM (SELECT {S.pattern('line')} AS pattern FROM doc_lines)
    WHERE pattern IS NOT NULL GROUP BY pattern HAVING count(*) >= 20)
),
defaults AS (SELECT * FROM (VALUES {", ".join(f"({_sql_str(p)}, {10**15 + i})" for i, p in enumerate(IO.DEFAULT_PREFIXES))}) d(pattern, rk)),
allp AS (SELECT pattern, min(rk) AS rk FROM (SELECT * FROM pats UNION ALL SELECT * FROM defaults) GROUP BY pattern),
hits AS (
  SELECT q.doc_id, q.line_no, arg_min(length(p.pattern), p.rk) AS pe
  FROM all_q q JOIN allp p ON starts_with(lower(q.q), p.pattern || ' ') OR lower(q.q) = p.pattern
  GROUP BY q.doc_id, q.line_no
)""") + """
SELECT q.doc_id, q.line_no, CAST(h.pe AS INTEGER) AS prefix_end
FROM all_q q LEFT JOIN hits h ON q.doc_id = h.doc_id AND q.line_no = h.line_no""")
def q_prefix_from_patterns(spark, sf):
    """E5: all openings that occur 20 times or more become the protected
    prefix table."""
    prefixes = W.learned_prefixes(doc_lines(spark, sf), "line", 20)
    e = PF.prefix_end_from(_questions(spark, sf), "q", prefixes)
    return e.select("doc_id", "line_no", "prefix_end")


@query("write_matches_roundtrip", sql=ORACLE["coverage_matches"])
def q_write_matches(spark, sf):
    """Matched rows written one folder per (match_type, n_words), read back."""
    tr, te = _doc_split(spark, sf)
    m = C.coverage_matches(tr, te)
    path = _scratch(spark, "matches")
    IO.write_matches(m, path)
    back = IO._csv(spark).csv(path)      # partition columns come back from the folder names
    return back.select("templated_question", "normalized_template", "match_type",
                       F.col("n_words").cast("int").alias("n_words"), "key", "matched_train_template")


@query("write_splits_roundtrip", sql=ORACLE["split_exact"])
def q_write_splits(spark, sf):
    """Exact split written one folder per split, read back."""
    s = X.split_exact(table(spark, sf, "documents").select("doc_id"), "doc_id")
    path = _scratch(spark, "splits")
    IO.write_splits(s, path)
    return IO._csv(spark).csv(path).select(F.col("doc_id").cast("long").alias("doc_id"), "split")


@query("write_templates_roundtrip", sql=ORACLE["templates_from_questions"])
def q_write_templates(spark, sf):
    """S10 + S5: the nine-column templates CSV written and read back."""
    e = _questions(spark, sf).withColumnRenamed("q", "research_question")
    path = _scratch(spark, "templates")
    IO.write_templates(CH.wide_templates(CH.templates_from_questions(e)), path)
    return IO.read_templates(spark, path, na="none")


@query("abstracts_from_pages", sql=f"""
WITH a AS ({_flat_sql("article")}), n AS ({_flat_sql("nav")}), l AS (SELECT * FROM ({_flat_sql("li")}) WHERE pos = 0), {_LINKS_SQL.strip()}
SELECT CAST(row_number() OVER (ORDER BY a.url, a.pos, a.text) AS BIGINT) AS id, l.text AS title, a.text AS abstract,
       regexp_extract(a.url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) || h.href AS url
FROM a JOIN n ON a.page_id = n.page_id AND a.pos = n.pos JOIN l ON l.page_id = a.page_id
JOIN (SELECT page_id, first(href ORDER BY k) AS href FROM hrefs GROUP BY page_id) h ON h.page_id = a.page_id""")
def q_abstracts_from_pages(spark, sf):
    """Articles zipped with the page's navigation, whose first list
    item gives title and link; defaults, ids."""
    p = spread(table(spark, sf, "pages"))
    return H.abstracts_from_pages(p, "article", None, "nav", None, H.site_base("url"), inner="li")


@query("abstracts_defaults", sql=f"""
WITH a AS ({_flat_sql("article")}), n AS ({_flat_sql("nav")}), o AS (SELECT DISTINCT page_id FROM pages WHERE regexp_matches(html, '(?i)<strong[\\s>]'))
SELECT CAST(row_number() OVER (ORDER BY a.url, a.pos, a.text) AS BIGINT) AS id, 'No Title' AS title, a.text AS abstract, 'No URL' AS url
FROM a JOIN n ON a.page_id = n.page_id AND a.pos = n.pos WHERE a.page_id NOT IN (SELECT page_id FROM o)""")
def q_abstracts_defaults(spark, sf):
    """H8: blocks without a title element get the default title and address."""
    p = spread(table(spark, sf, "pages")).filter(~F.col("html").rlike(r"(?i)<strong[\s>]"))
    return H.abstracts_from_pages(p, "article", None, "nav", None, H.site_base("url"))


@query("select_existing_columns", sql="SELECT doc_id, source, lang FROM documents")
def q_select_existing(spark, sf):
    """A table that must have some columns, cut to those that exist."""
    d = table(spark, sf, "documents")
    IO.require_columns(d, ["doc_id", "text"])
    return IO.select_existing(d, ["doc_id", "title", "source", "lang", "EC1"])


@query("extract_template_collapsed")
def q_extract_collapsed(spark, sf):
    """T2 with the predicate pass reading the collapsed first annotation."""
    e = _questions(spark, sf).withColumnRenamed("q", "research_question")
    return CH.extract_template_with_mapping(e, reannotate=False).select(
        "doc_id", "line_no", "templated_question", "mapping")


# ---------------------------------------------------------------- a lexicon table, all rules, and the whole chain

from qtemplates.operators import lexicon as LX  # noqa: E402
from qtemplates.session import cut_lineage  # noqa: E402

_LEXICON_SQL = _TOKENS_SQL.replace(
    "              WHEN regexp_matches(lower(text), 'ly$') THEN 'ADV'",
    f"""              WHEN lower(text) IN (SELECT word FROM lexi) AND lower(text) NOT IN {_in(A.VERB_WORDS)}
                THEN CASE length(lower(text)) % 3 WHEN 0 THEN 'VERB' WHEN 1 THEN 'ADJ' ELSE 'NOUN' END
              WHEN regexp_matches(lower(text), 'ly$') THEN 'ADV'""")


def _first_words(q: DataFrame) -> DataFrame:
    """A lexicon as large as the data: the first word of every line, with a tag
    by its length."""
    word = F.lower(F.regexp_extract("q", r"[\p{L}\p{N}_]+", 0)).alias("word")
    tag = F.element_at(F.array(F.lit("VERB"), F.lit("ADJ"), F.lit("NOUN")), (F.length("word") % 3 + 1).cast("int"))
    return q.select(word).filter("word <> ''").distinct().select("word", tag.alias("pos"), F.lit(False).alias("noun_after"))


@query("annotate_with_lexicon", sql=_with(S.DOC_LINES, _Q_SQL, """
lexi AS (SELECT DISTINCT lower(regexp_extract(q, '[\\p{L}\\p{N}_]+')) AS word FROM all_q)""", _LEXICON_SQL) + """
SELECT doc_id, line_no, CAST(i AS INTEGER) AS i, idx, text, pos,
       CASE WHEN h IS NOT NULL THEN 'aux' ELSE '' END AS dep, CAST(coalesce(h, i) AS INTEGER) AS head
FROM tokd""")
def q_annotate_lexicon(spark, sf):
    """A1 with a lexicon table: the default words before those of the data."""
    e = _questions(spark, sf)
    words = cut_lineage(LX.extend_lexicon(_first_words(e), LX.default_lexicon(spark)), "lexicon")
    t = LX.annotate_with_lexicon(e, "q", words)
    return t.select("doc_id", "line_no", F.explode("tokens").alias("t")).select("doc_id", "line_no", "t.*")


# questions on which the rules C7 (How + adjective + verb), C8 (the thing) and
# C9 (final quality, final verb after a copula) fire, made of every line
_FORMS_SQL = _with(S.DOC_LINES, _Q_SQL, f"""
worded AS (SELECT *, lower(regexp_extract(q, '\\p{{L}}+')) AS w FROM all_q),
formed AS (SELECT doc_id, line_no, unnest(['C7', 'C8', 'C9a', 'C9v']) AS form,
                  unnest(['How ' || w || 'al ' || w || 'ing ' || q || '?', 'Is the thing ' || q || '?', q || ' ' || w || 'ly?', q || ' are ' || w || 'ed?']) AS q
           FROM worded WHERE w <> ''),
src AS (SELECT DISTINCT md5(q) AS k, q FROM formed)""").rstrip() + ",\n" + XS.templates("src", "mapping", ("thing",))


def _worded(spark, sf) -> DataFrame:
    """doc_id, line_no, q and w, the first word in lower case, of every line with a word."""
    return _questions(spark, sf).withColumn("w", F.lower(F.regexp_extract("q", r"\p{L}+", 0))).filter("w <> ''")


def _forms(rows: DataFrame) -> DataFrame:
    """q, form and the question of that form for every row."""
    q, w = F.col("q"), F.col("w")
    made = {"C7": F.concat(F.lit("How "), w, F.lit("al "), w, F.lit("ing "), q, F.lit("?")), "C8": F.concat(F.lit("Is the thing "), q, F.lit("?")),
            "C9a": F.concat(q, F.lit(" "), w, F.lit("ly?")), "C9v": F.concat(q, F.lit(" are "), w, F.lit("ed?"))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("research_question")) for k, v in made.items()]))
    return rows.select("q", each.alias("x")).select("q", "x.*")


@query("question_rules", sql=_FORMS_SQL + """
SELECT x.doc_id, x.line_no, x.form, f.q AS templated_question, coalesce(m.mapping, '') AS mapping
FROM formed x JOIN final f ON f.k = md5(x.q) LEFT JOIN maps m ON m.k = f.k""")
def q_question_rules(spark, sf):
    """C7, C8 and C9 on questions made of every line, with a lexicon that
    knows "thing" as a noun."""
    words = LX.extend_lexicon(LX.default_lexicon(spark), spark.createDataFrame([("thing", "NOUN", False)], LX.SCHEMA))
    lines = _worded(spark, sf)
    # copies of a line collapse before its questions are made, and lines, not questions, meet the templates
    made = CH.extract_template_with_mapping(_forms(lines.select("q", "w").distinct()), annotator=LX.lexicon_annotator(words))
    made = cut_lineage(made.select("q", "form", "templated_question", _map_text().alias("mapping")), "rules")
    return lines.select("doc_id", "line_no", "q").join(made, "q").select("doc_id", "line_no", "form", "templated_question", "mapping")


def _chain(spark, sf) -> DataFrame:
    """Templates of all distinct lines with their maps, extracted once."""
    q = _questions(spark, sf).select(F.col("q").alias("research_question")).distinct()
    return cut_lineage(CH.extract_template_with_mapping(q), "chain")


_CHAIN_SQL = _TEXTS + XS.templates("src", "mapping") + f""",
tagged AS (SELECT f.q AS templated_question, CASE WHEN {S.hash_test('s.q')} THEN 'test' ELSE 'train' END AS split FROM src s JOIN final f ON f.k = s.k)"""


def _chain_split(spark, sf):
    t = _chain(spark, sf)
    is_test = X.split_hash_col("research_question")
    return t.filter(~is_test), t.filter(is_test)


@query("chain_coverage", sql=_CHAIN_SQL + ",\n" + _keys_cte(C.level_list()) + """,
train_keys AS (SELECT DISTINCT match_type, n_words, key FROM keys WHERE split = 'train' AND key <> '')
""" + ORACLE["run_coverage"][ORACLE["run_coverage"].rindex("SELECT t.match_type"):])
def q_chain_coverage(spark, sf):
    """Question -> template -> split -> coverage at every level."""
    return C.run_coverage(*_chain_split(spark, sf))


@query("chain_corpus_bleu", sql=_CHAIN_SQL + ",\n" + S.bleu_sides("SELECT templated_question AS t FROM tagged WHERE split = 'train'", "SELECT templated_question AS t FROM tagged WHERE split = 'test'").strip()
       + ",\n" + _CORPUS.strip() + "\n" + ORACLE["corpus_bleu"][ORACLE["corpus_bleu"].rindex("SELECT round(coalesce"):])
def q_chain_bleu(spark, sf):
    """Question -> template -> split -> corpus BLEU."""
    tr, te = _chain_split(spark, sf)
    return B.corpus_bleu(tr, te, "templated_question").select(F.round("corpus_bleu", 9).alias("corpus_bleu"))


@query("chain_chunks", sql=_TEXTS + XS.templates("src", "mapping") + f""",
counts AS (SELECT key AS marker, lower({S.strip('v')}) AS chunk, count(*)::BIGINT AS frequency FROM entries WHERE {S.strip('v')} <> '' GROUP BY ALL HAVING count(*) >= 2)
SELECT marker, row_number() OVER (PARTITION BY marker ORDER BY frequency DESC, chunk) AS rank, chunk, frequency FROM counts""")
def q_chain_chunks(spark, sf):
    """Question -> marker map -> chunk frequencies of every marker found."""
    return K.chunk_frequency_of_maps(_chain(spark, sf))


@query("templates_in_order", sql=_TEXTS + XS.templates("src", "mapping") + """
SELECT row_number() OVER (ORDER BY length(f.q), f.q, s.q) AS place, f.q AS templated_question, s.q AS research_question FROM src s JOIN final f ON f.k = s.k""")
def q_templates_in_order(spark, sf):
    """T4 as data: the place of every template in the order by length."""
    from qtemplates.operators.ids import assign_ids
    t = _chain(spark, sf).select("templated_question", "research_question")
    return assign_ids(t, [F.length("templated_question"), "templated_question", "research_question"], id_col="place")


@query("split_exact_repeated_key", sql="""
WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || lang), lang, doc_id) AS n, count(*) OVER () AS total FROM documents)
SELECT doc_id, lang, CASE WHEN n <= ceil(0.2 * total) THEN 'test' ELSE 'train' END AS split FROM r""")
def q_split_repeated(spark, sf):
    """X1 on a key of few values: the cut falls among rows of one key."""
    return X.split_exact(table(spark, sf, "documents").select("doc_id", "lang"), "lang", bucket_rows=64)


# ---------------------------------------------------------------- the rest of the seams: S6, S8, S13, K7, Q2, F3, G7

@query("read_template_pairs", sql=_with(S.DOC_LINES) + f"""
SELECT 'train' AS split, line AS template FROM doc_lines WHERE line_no % 2 = 0
UNION ALL SELECT 'test', {S.words('line')}[1] FROM doc_lines WHERE doc_id % 3 = 0""")
def q_read_pairs(spark, sf):
    """Ragged train and test columns written as CSV and read as pairs."""
    d = doc_lines(spark, sf)
    cell = lambda keep, x: F.when(keep, x).otherwise(F.lit(""))
    path = _scratch(spark, "pairs")
    IO.write_csv(d.select(cell(F.col("line_no") % 2 == 0, F.col("line")).alias("train_templates"),
                          cell(F.col("doc_id") % 3 == 0, F.get(T.py_split("line"), 0)).alias("test_templates")), path)
    return IO.read_template_pairs(spark, path)


@query("load_prefix_table", sql=_with(S.DOC_LINES) + f"""
SELECT pattern, min(rank) AS rank FROM (
  SELECT pattern, row_number() OVER (ORDER BY count(*) DESC, min(line), pattern) - 1 AS rank
  FROM (SELECT {S.pattern('line')} AS pattern, line FROM doc_lines) WHERE pattern IS NOT NULL GROUP BY pattern HAVING count(*) >= 20
  UNION ALL SELECT * FROM (VALUES {", ".join(f"({_sql_str(p)}, {IO._AFTER + i})" for i, p in enumerate(IO.DEFAULT_PREFIXES))}))
GROUP BY pattern""")
def q_load_prefixes(spark, sf):
    """S8 + U2: the frequent patterns written as CSV and read as a prefix table."""
    path = _scratch(spark, "patterns")
    IO.write_csv(K.pattern_frequency(doc_lines(spark, sf), "line", 5, 20), path)
    return IO.load_prefix_table(spark, path).select("pattern", "rank")


_CLEANED = """trim(regexp_replace(line, '^\\s*["'']?\\d+[.)]\\s*', ''), ' "''' || chr(10))"""


def _line_model():
    """Stand-in model: echoes the prompt and answers with the abstract."""
    def gen(prompts):
        return [p + "\n" + p.split("Abstract:\n", 1)[-1] for p in prompts]
    return gen


@query("generation_counts", sql=f"""
WITH a AS (SELECT doc_id, {S.strip("coalesce(text, '')")} AS t FROM documents),
l AS (SELECT unnest(string_split(t, chr(10))) AS line FROM a WHERE t <> ''),
q AS (SELECT {_CLEANED} AS q FROM l)
SELECT 0 AS place, 'abstracts' AS stage, count(*) AS rows FROM a
UNION ALL SELECT 1, 'prompts', count(*) FROM a WHERE t <> '' UNION ALL SELECT 2, 'responses', count(*) FROM a WHERE t <> ''
UNION ALL SELECT 3, 'lines', count(*) FROM l UNION ALL SELECT 4, 'questions', count(*) FROM q WHERE q <> ''""")
def q_generation_counts(spark, sf):
    """A generation job with its prompt in a file; rows of each stage."""
    path = _scratch(spark, "generation")
    spark.createDataFrame([(PROMPT,)], "value string").coalesce(1).write.text(f"{path}/prompt")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("abstract"), F.lit("").alias("url"))
    return W.generation_report(spark, spread(d), f"{path}/prompt", _line_model, f"{path}/questions")


# ---------------------------------------------------------------- file order: S3, S5, ties of K2, K3, K4, J1, F4

_ORDERED_SQL = _with(S.DOC_LINES, """
rows AS (SELECT line, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS row_no, count(*) OVER () AS n FROM doc_lines)""")


def _in_file_order(spark, sf) -> DataFrame:
    """Document lines written as a questions CSV of several files, read back
    with the number of each row."""
    path = _scratch(spark, "ordered")
    d = doc_lines(spark, sf).sort("doc_id", "line_no").select(F.col("line").alias("research_question"))
    IO.write_csv(d, path)
    return IO.read_questions(spark, path, na="none", order="row_no")


@query("questions_in_file_order", sql=_ORDERED_SQL + "SELECT row_no, line AS research_question FROM rows")
def q_file_order(spark, sf):
    """S3: every row with its place over all files."""
    return _in_file_order(spark, sf)


@query("patterns_first_seen", sql=_ORDERED_SQL + f"""
SELECT row_number() OVER (ORDER BY count(*) DESC, min(row_no)) AS rank, pattern, count(*)::BIGINT AS frequency
FROM (SELECT {S.pattern('line')} AS pattern, row_no FROM rows) WHERE pattern IS NOT NULL GROUP BY pattern HAVING count(*) >= 2""")
def q_patterns_first_seen(spark, sf):
    """K2 with the place of every pattern; ties by first row."""
    return K.pattern_ranks(_in_file_order(spark, sf), order_by="row_no").select("rank", "pattern", "frequency")


@query("templates_first_seen", sql=_ORDERED_SQL + f"""
SELECT row_number() OVER (ORDER BY count(*) DESC, min(row_no)) AS rank, t AS templated_question, count(*)::BIGINT AS frequency
FROM (SELECT {S.strip('line')} AS t, row_no FROM rows) WHERE t <> '' GROUP BY t""")
def q_templates_first_seen(spark, sf):
    """K3 with the place of every template; ties by first row."""
    q = _in_file_order(spark, sf).withColumnRenamed("research_question", "templated_question")
    return K.template_ranks(q, order_by="row_no").select("rank", "templated_question", "frequency")


@query("chunks_first_seen", sql=_ORDERED_SQL + f"""
SELECT marker, row_number() OVER (PARTITION BY marker ORDER BY count(*) DESC, min(row_no)) AS rank, chunk, count(*)::BIGINT AS frequency
FROM (SELECT m.marker, row_no, lower({S.words('line')}[m.i]) AS chunk FROM rows, (VALUES {", ".join(f"('{m}', {i + 1})" for i, m in enumerate(K.DEFAULT_MARKERS))}) m(marker, i))
WHERE chunk <> '' GROUP BY marker, chunk HAVING count(*) >= 2""")
def q_chunks_first_seen(spark, sf):
    """K4 with ties by first row."""
    w = T.py_split("research_question")
    cells = [F.try_element_at(w, F.lit(i + 1)).alias(m) for i, m in enumerate(K.DEFAULT_MARKERS)]
    return K.chunk_frequency(_in_file_order(spark, sf).select("row_no", *cells), order_by="row_no")


@query("lookup_first_seen", sql=_ORDERED_SQL.rstrip() + "," + f"""
norm AS (SELECT row_no, {S.normalize('line')} AS nt FROM rows),
k AS (SELECT row_no, nt, n, {S.words('nt')} AS w FROM norm, (VALUES (5), (10)) v(n))
SELECT n AS n_words, array_to_string(list_slice(w, 1, n), ' ') AS key, arg_min(nt, row_no) AS matched_train_template
FROM k WHERE len(w) > 0 GROUP BY ALL""")
def q_lookup_first_seen(spark, sf):
    """The first row of the file for every opening."""
    q = _in_file_order(spark, sf).withColumnRenamed("research_question", "templated_question")
    levels = C.level_list((5, 10), (), False)
    return C.build_lookup(q, levels=levels, order_by=F.col("row_no")).select("n_words", "key", "matched_train_template")


@query("questions_first_kept", sql=_ORDERED_SQL + """
SELECT row_number() OVER (ORDER BY min(row_no)) - 1 AS place, min(row_no) AS row_no, line AS research_question FROM rows GROUP BY line""")
def q_first_kept(spark, sf):
    """the first of equal questions, numbered in file order."""
    from qtemplates.operators.ids import assign_ids
    kept = G.dedup_questions(_in_file_order(spark, sf), order_by="row_no")
    return assign_ids(kept, "row_no", start=0, id_col="place")


@query("frequency_csv_roundtrip", sql=ORACLE["template_frequency"])
def q_frequency_csv(spark, sf):
    """A frequency table written as CSV and read back."""
    path = _scratch(spark, "frequency")
    IO.write_csv(QUERIES["template_frequency"](spark, sf), path)
    return IO.read_templates(spark, path, na="none").select("templated_question", F.col("frequency").cast("long").alias("frequency"))


@query("coverage_order", sql=f"""
SELECT CAST(row_number() OVER (ORDER BY match_type, n_words NULLS FIRST) AS BIGINT) AS rank, match_type, n_words, matched
FROM ({ORACLE["run_coverage"]})""")
def q_coverage_order(spark, sf):
    """K7 as data: the place of each row of the ordered summary."""
    ordered = C.order_summary(QUERIES["run_coverage"](spark, sf))
    from qtemplates.operators.ids import assign_ids
    ranked = assign_ids(ordered, ["match_type", F.col("n_words").asc_nulls_first()], id_col="rank")
    return ranked.select("rank", "match_type", "n_words", "matched")


@query("starter_tokens", sql=_with(S.DOC_LINES, _Q_SQL, _TOKENS_SQL) + f"""
, w AS (SELECT doc_id, line_no, max(CASE WHEN i = 0 THEN lower(text) END) AS w0, max(CASE WHEN i = 1 THEN lower(text) END) AS w1
        FROM tk GROUP BY doc_id, line_no),
f AS (SELECT *, coalesce(w0 IN {_in(PF.STARTER_WORDS)}, false) AS one,
             coalesce(w0 || ' ' || w1 IN {_in([f"{a} {b}" for a, b in PF.STARTER_PAIRS])}, false) AS two FROM w)
SELECT doc_id, line_no, one OR two AS first_is_starter, two AS second_is_starter FROM f""")
def q_starters(spark, sf):
    """Q2 at the first two tokens of every line."""
    # bound once a line: as a filter on the tokens Spark would annotate again for it
    def flags(t):
        w0, w1 = F.lower(F.get(t, 0)["text"]), F.lower(F.get(t, 1)["text"])
        at = lambda i: F.coalesce(PF.starter_at(F.lit(i), w0, w1, F.size(t)), F.lit(False))
        return F.when(F.size(t) > 0, F.array(F.struct(at(0).alias("first_is_starter"), at(1).alias("second_is_starter"))))
    each = _questions(spark, sf).select("doc_id", "line_no", F.explode(A.let(A.lexicon_tokens(F.col("q")), flags)).alias("x"))
    return each.select("doc_id", "line_no", "x.*")


@query("questions_missing_url", sql=_with(S.DOC_LINES) + f"""
SELECT CASE WHEN doc_id % 2 = 0 THEN 'doc:' || doc_id ELSE '' END AS url, research_question
FROM (SELECT doc_id, {_CLEANED} AS research_question FROM doc_lines) WHERE research_question <> ''""")
def q_missing_url(spark, sf):
    """questions of abstracts without an address get an empty one."""
    url = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    return G.questions(doc_lines(spark, sf).select("line", url.alias("url"))).select("url", "research_question")


def _careless_model():
    """Fails on some prompts, and answers too few of a batch."""
    def gen(prompts):
        if len(prompts) > 1:
            return ["lost"]
        if len(prompts[0]) % 7 == 0:
            raise RuntimeError("refused")
        return [f"{len(prompts[0])}"]
    return gen


@query("generation_skips_failures", sql="""
SELECT doc_id, CAST(length(text) AS VARCHAR) AS generated_text FROM documents WHERE length(text) % 7 <> 0""")
def q_skips(spark, sf):
    """Rows whose prompt the model refuses are left out, all others kept."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    return G.generate_text(d, _careless_model, on_error="skip").select("doc_id", "generated_text")
