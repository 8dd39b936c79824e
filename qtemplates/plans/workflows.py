"""End-to-end jobs composed from the operators.

Each function declares the whole plan and runs one action at the end (a
write); row counts (K8) are collected with ``observe`` metrics on that same
action instead of extra ``count()`` jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from qtemplates.operators import bleu as B
from qtemplates.operators import chunk as CH
from qtemplates.operators import coverage as C
from qtemplates.operators import frequency as K
from qtemplates.operators import generate as G
from qtemplates.operators import split as X
from qtemplates.sources import io as IO


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """K8: attach a row-count metric that is filled by the next action."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


class StageCounts:
    """K8 for several stages of one job: ``watch`` attaches a row count to
    each, the job's only action fills them, ``table`` returns them."""

    def __init__(self):
        self.seen: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, stage: str) -> DataFrame:
        df, obs = counted(df, f"stage-{len(self.seen)}")
        self.seen.append((stage, obs))
        return df

    def table(self, spark: SparkSession) -> DataFrame:
        """(place, stage, rows), in the order of the stages."""
        rows = [(n, stage, obs.get["rows"]) for n, (stage, obs) in enumerate(self.seen)]
        return spark.createDataFrame(rows, "place int, stage string, rows long")


def generation_report(spark: SparkSession, abstracts: DataFrame, prompt_path: str, make_generator, out_path: str,
                      numbering: str = "strict", on_error: str = "fail") -> DataFrame:
    """E1 with its prompt from a file (S7): questions CSV written to
    ``out_path``; returns how many rows each stage had (K8), counted on the way."""
    counts = StageCounts()
    q = G.questions_from_abstracts(abstracts, IO.read_prompt(spark, prompt_path), make_generator, numbering=numbering, on_error=on_error, watch=counts.watch)
    IO.write_csv(q, out_path)
    return counts.table(spark)


def abstracts_to_questions(abstracts: DataFrame, template: str, make_generator, out_path: str,
                           lo: int | None = None, hi: int | None = None, numbering: str = "strict",
                           on_error: str = "fail") -> int:
    """Abstracts -> generated questions CSV (url, research_question), of
    all ids or of ``lo``..``hi``."""
    q = G.questions_from_abstracts(abstracts, template, make_generator, lo=lo, hi=hi,
                                   numbering=numbering, on_error=on_error)
    q, obs = counted(q, "questions")
    IO.write_csv(q, out_path)
    return obs.get["rows"]


def split_questions(questions: DataFrame, key: str, out_path: str, test: float = 0.2,
                    seed: int = 42, exact: bool = True) -> None:
    """Train/test split written as one folder per split."""
    s = X.split_exact(questions, key, test, seed) if exact else X.split_hash(questions, key, test, seed)
    IO.write_splits(s, out_path)


def questions_to_templates(questions: DataFrame, out_path: str, prefixes: Sequence[str] | None = None,
                           annotator=None) -> int:
    """Questions -> the nine-column templates CSV, ordered by length."""
    t = CH.wide_templates(CH.templates_from_questions(questions, "research_question", prefixes, annotator))
    t, obs = counted(t, "templates")
    IO.write_templates(t, out_path)
    return obs.get["rows"]


def coverage_report(train: DataFrame, test: DataFrame, out_path: str,
                    templ_col: str = "templated_question") -> DataFrame:
    """Summary (returned, 15 rows) and matched rows of full / 10 / 11 words
    (written one folder per level)."""
    IO.write_matches(C.coverage_matches(train, test, templ_col), f"{out_path}/matches")
    return C.order_summary(C.run_coverage(train, test, templ_col))


def bleu_report(train: DataFrame, test: DataFrame, col: str = "templated_question") -> dict:
    """Average best sentence BLEU and corpus BLEU (two scalars)."""
    avg = B.average_bleu(B.max_sentence_bleu(train, test, col)).first()[0]
    corp = B.corpus_bleu(train, test, col).first()[0]
    return {"sentence_bleu": avg, "corpus_bleu": corp}


def learned_prefixes(questions: DataFrame, col: str = "research_question", min_count: int = 20) -> DataFrame:
    """E5: (pattern, rank) of all five-word openings that occur at least
    ``min_count`` times, most frequent first, followed by the default starters:
    the table that ``prefix_end_from`` protects, however many there are."""
    from qtemplates.operators.ids import assign_ids
    from qtemplates.sources.io import prefix_table

    learned = assign_ids(K.pattern_frequency(questions, col, 5, min_count), [F.desc("frequency"), F.col("pattern")], id_col="rank")
    return prefix_table(learned.select("pattern", "rank"))
