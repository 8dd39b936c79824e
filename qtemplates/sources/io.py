"""Readers, writers and schema guards.

CSV files of this domain hold commas, quotes and newlines inside fields, so
every CSV read/write uses ``quote='"'``, ``escape='"'`` (RFC 4180 doubling)
and ``multiLine=True``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qtemplates.functions.text import null_if_na, py_strip
from qtemplates.sources.order import number_rows

ABSTRACT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()), T.StructField("url", T.StringType())])

TEMPLATE_COLS = ["research_question", "templated_question",
                 "EC1", "EC2", "EC3", "EC4", "EC5", "PC1", "PC2"]

# Question starters appended to a prefix list when missing,
# single words first, then two-word forms, in this order.
DEFAULT_PREFIXES = [
    "can", "do", "does", "did", "will", "would", "could", "should", "shall", "may", "might",
    "is", "are", "was", "were", "has", "have", "had",
    "what", "which", "when", "where", "who", "whom", "whose", "why", "how",
    "can a", "can the", "do the", "does the", "did the",
    "will a", "will the", "would a", "would the",
    "could a", "could the", "should a", "should the",
    "how can", "how do", "how does", "how will", "how would", "how could", "how should",
    "what can", "what do", "what does", "what will", "what would",
    "when can", "when do", "when does", "when will", "when would",
    "where can", "where do", "where does", "where will", "where would",
    "why can", "why do", "why does", "why will", "why would",
    "which can", "which do", "which does", "which will", "which would",
]


def _csv(spark: SparkSession, multi_line: bool = True):
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).option("mode", "FAILFAST"))


def read_abstracts(spark: SparkSession, path: str, json_array: bool = True) -> DataFrame:
    """Abstracts (id, title, abstract, url).  A JSON array file needs
    ``multiLine``; at scale prefer JSON lines (splittable)."""
    return spark.read.schema(ABSTRACT_SCHEMA).option("multiLine", json_array).json(path)


def write_abstracts(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, UTF-8, non-ASCII kept as is."""
    df.select("id", "title", "abstract", "url").write.mode(mode).json(path)


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    """Raise ``ValueError`` naming the missing columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")


def select_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """keep only the listed columns that exist, in the listed order."""
    return df.select(*[c for c in cols if c in df.columns])


def read_questions(spark: SparkSession, path: str, na: str = "pandas", multi_line: bool = True, order: str | None = None) -> DataFrame:
    """S3 (+S4): questions CSV with header, every column STRING.

    ``na='pandas'`` turns the pandas missing-value spellings into null, like
    ``pd.read_csv``; ``na='none'`` keeps '' like ``csv.DictReader``.  Without
    ``multi_line`` large files are split among tasks; fields must then hold no
    newline.  ``order`` names a column that gets each row's number in file
    order (from 0, by file path), for "first seen" ties."""
    df = _csv(spark, multi_line).csv(path)
    cols = df.columns
    if order is not None:
        df = number_rows(df, order)
    kept = [c for c in df.columns if c not in cols]
    if na == "pandas":
        df = df.select(*kept, *[null_if_na(F.col(c)).alias(c) for c in cols])
    elif na != "none":
        raise ValueError("na must be 'pandas' or 'none'")
    else:
        df = df.select(*kept, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in cols])
    return df


def read_templates(spark: SparkSession, path: str, na: str = "pandas", order: str | None = None) -> DataFrame:
    """Templates CSV (wide); requires ``templated_question``."""
    df = read_questions(spark, path, na, order=order)
    require_columns(df, ["templated_question"])
    return df


def read_template_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Ragged ``train_templates``/``test_templates`` columns -> long
    (split, template), blank cells dropped per side."""
    df = read_questions(spark, path, na="none")
    require_columns(df, ["train_templates", "test_templates"])
    long = df.unpivot([], ["train_templates", "test_templates"], "split", "template")
    return (long.filter(py_strip("template") != "")
                .withColumn("split", F.regexp_replace("split", "_templates$", "")))


def read_prompt(spark: SparkSession, path: str) -> str:
    """The prompt file as one stripped string (a small driver value)."""
    row = spark.read.text(path, wholetext=True).first()
    return (row[0] if row else "").strip()


def prefix_table(patterns: DataFrame) -> DataFrame:
    """(pattern, rank) with every missing default behind all given ones."""
    defaults = patterns.sparkSession.createDataFrame([(p, _AFTER + i) for i, p in enumerate(DEFAULT_PREFIXES)], "pattern string, rank long")
    return patterns.select("pattern", F.col("rank").cast("long").alias("rank")).unionByName(defaults).groupBy("pattern").agg(F.min("rank").alias("rank"))


#: Rank of the first default, behind any learned or listed pattern.
_AFTER = 1 << 62
#: A list kept in the plan as one expression; longer ones are tables.
MAX_LISTED = 10_000


def load_prefix_table(spark: SparkSession, path: str) -> DataFrame:
    """S8 + U2 for lists of any size: (pattern, rank) of the ``pattern`` column
    (non-empty, stripped, lower-cased) ranked by row of the file, then the defaults."""
    df = read_questions(spark, path, na="none", order="rank")
    require_columns(df, ["pattern"])
    p = F.lower(py_strip("pattern"))
    return prefix_table(df.select(p.alias("pattern"), "rank").filter(F.col("pattern") != ""))


def load_prefixes(spark: SparkSession, path: str | None = None) -> list[str]:
    """S8 + U2: ``pattern`` column (non-empty, stripped, lower-cased) in file
    order, then every missing default, as a list of at most ``MAX_LISTED``
    patterns; ``load_prefix_table`` takes longer ones."""
    pats: list[str] = []
    if path:
        try:
            df = read_questions(spark, path, na="none", order="_o")
        except AnalysisException as e:  # a missing file gives the defaults only
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            df = None
        if df is not None and "pattern" in df.columns:
            rows = (df.select("_o", "pattern")
                      .filter(F.col("pattern") != "").orderBy("_o").limit(MAX_LISTED + 1).collect())
            if len(rows) > MAX_LISTED:
                raise ValueError(f"more than {MAX_LISTED} patterns; use load_prefix_table")
            pats = [r["pattern"].strip().lower() for r in rows]
    for p in DEFAULT_PREFIXES:
        if p not in pats:
            pats.append(p)
    return pats


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] | None = None) -> None:
    """Header, ``"`` quoting with doubling, UTF-8; white
    space at the edges of a field is kept."""
    w = (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
           .option("encoding", "UTF-8").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_templates(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The fixed nine template columns."""
    write_csv(df.select(*TEMPLATE_COLS), path, mode)


def write_splits(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """Train and test in one write, one folder per split."""
    write_csv(df, path, mode, [split_col])


def write_matches(matches: DataFrame, path: str, levels=None, mode: str = "overwrite") -> None:
    """Matched rows, one folder per (match_type, n_words); all that are
    given, or those of ``levels``, pairs of match_type and n_words."""
    if levels is not None:
        cond = F.lit(False)
        for mt, n in levels:
            cond = cond | ((F.col("match_type") == mt) & F.col("n_words").eqNullSafe(F.lit(n)))
        matches = matches.filter(cond)
    write_csv(matches, path, mode, ["match_type", "n_words"])
