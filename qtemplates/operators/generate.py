"""Question generation jobs: prompt -> model text -> one row per question.

The model itself is the caller's: ``make_generator()`` builds it once per
Python worker and it is called on slices of Arrow batches of prompts inside
``mapInArrow``.  Everything around it (prompt filling, echo removal, line
split, cleaning, filtering) is Column work that stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qtemplates.functions.text import clean_line, not_blank, py_strip
from qtemplates.operators.ids import assign_ids
from qtemplates.session import function_key


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def id_range_filter(df: DataFrame, lo: int | None, hi: int | None, col: str = "id") -> DataFrame:
    """keep ids in the closed range [lo, hi], open where an end is None;
    pushed down to the scan."""
    if lo is not None:
        df = df.filter(F.col(col) >= lo)
    return df if hi is None else df.filter(F.col(col) <= hi)


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """drop rows whose text is null or blank after strip."""
    return df.filter(F.col(col).isNotNull() & not_blank(col))


def dedup_questions(df: DataFrame, col: str = "research_question", order_by: str | None = None) -> DataFrame:
    """one column, nulls dropped, exact duplicates dropped; with
    ``order_by`` (a row number) also the smallest one of each, so that the
    first of equal rows is the one kept."""
    if order_by is None:
        return df.select(col).na.drop().dropDuplicates()
    return df.select(col, order_by).filter(F.col(col).isNotNull()).groupBy(col).agg(F.min(order_by).alias(order_by))


def render_prompt(df: DataFrame, template: str, slots: dict | None = None,
                  out: str = "prompt") -> DataFrame:
    """G1: fill ``{name}`` slots of ``template`` like ``str.format`` with
    the stripped column values (``{{``/``}}`` become literal braces).  The
    template is split on the driver; each row is one ``concat``."""
    slots = slots or {"abstract": "abstract"}
    parts: list = [template]
    for name, col in slots.items():
        nxt: list = []
        for p in parts:
            if isinstance(p, str):
                pieces = p.split("{" + name + "}")
                for i, piece in enumerate(pieces):
                    if i:
                        nxt.append(py_strip(_c(col)))
                    nxt.append(piece)
            else:
                nxt.append(p)
        parts = nxt
    cols = [F.lit(p.replace("{{", "{").replace("}}", "}")) if isinstance(p, str) else p for p in parts]
    return df.withColumn(out, F.concat(*cols))


_GEN_CACHE: dict = {}
#: Characters of prompts given to the generator at once (a longer prompt alone).
_CHARS = 1 << 20


def _slices(batches: Iterable, col: str):
    """Batches in slices of about ``_CHARS`` characters of prompts, whatever
    their rows, so that few prompts and texts are held as Python objects."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _CHARS, "right")))
            yield batch.slice(i, j - i)
            i = j


def generate_text(df: DataFrame, make_generator: Callable[[], Callable[[Sequence[str]], Sequence[str]]],
                  prompt_col: str = "prompt", out: str = "generated_text",
                  on_error: str = "fail") -> DataFrame:
    """G2 + G7: run the caller's generator on slices of Arrow batches of
    prompts; other columns pass as they are.

    ``make_generator()`` is called once per Python worker; the generator maps
    a list of prompts to a list of texts.  ``on_error='skip'`` keeps going:
    a failing batch is retried row by row and failing rows get a null text
    and the message in ``error``; ``'fail'`` stops the job."""
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error must be 'fail' or 'skip'")
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.StringType()),
                                              T.StructField("error", T.StringType())])
    # the function is unpickled anew for every task: key the per-worker cache
    # by content, not by object identity
    key = function_key(make_generator)

    def run(batches: Iterable):
        # look the cache up through the module: a global captured by this
        # closure would be pickled by value, i.e. fresh for every task
        from qtemplates.operators import generate as mod
        gen = mod._GEN_CACHE.get(key)
        if gen is None:
            gen = mod._GEN_CACHE[key] = make_generator()
        for batch in _slices(batches, prompt_col):
            prompts = batch.column(prompt_col).to_pylist()
            texts, errors = None, [None] * len(prompts)
            try:
                texts = list(gen(prompts))
                if len(texts) != len(prompts):
                    raise ValueError(f"generator gave {len(texts)} texts for {len(prompts)} prompts")
            except Exception:  # noqa: BLE001
                if on_error == "fail":
                    raise
                texts = None  # which row is at fault shows only one by one
            if texts is None:
                texts = []
                for i, p in enumerate(prompts):
                    try:
                        texts.append(list(gen([p]))[0])
                    except Exception as e:  # noqa: BLE001
                        texts.append(None)
                        errors[i] = f"{type(e).__name__}: {e}"
            more = [pa.array(texts, pa.string(), from_pandas=True), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, out, "error"])

    res = df.mapInArrow(run, schema)
    return res.filter(F.col("error").isNull()) if on_error == "skip" else res


def strip_echo(df: DataFrame, prompt_col: str = "prompt", text_col: str = "generated_text",
               out: str = "response") -> DataFrame:
    """Drop the echoed prompt by length (not by prefix test), then strip."""
    tail = F.expr(f"substring(`{text_col}`, length(`{prompt_col}`) + 1)")
    return df.withColumn(out, py_strip(tail))


def explode_lines(df: DataFrame, col: str = "response", pos: str = "pos", out: str = "line") -> DataFrame:
    """One row per ``\\n``-separated line, empty lines kept."""
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.posexplode(F.split(col, "\n", -1)).alias(pos, out))


def questions(df: DataFrame, line_col: str = "line", numbering: str = "strict",
              url_col: str | None = "url") -> DataFrame:
    """G5 + G6 + F3: clean each line, drop empty ones, attach the url ('' if missing)."""
    q = df.withColumn("research_question", clean_line(line_col, numbering))
    q = q.filter(F.col("research_question") != "")
    url = F.coalesce(F.col(url_col), F.lit("")) if url_col and url_col in df.columns else F.lit("")
    return q.withColumn("url", url)


def questions_from_abstracts(abstracts: DataFrame, template: str, make_generator, *,
                             id_col: str = "id", lo: int | None = None, hi: int | None = None,
                             numbering: str = "strict", on_error: str = "fail",
                             watch: Callable[[DataFrame, str], DataFrame] = lambda df, stage: df) -> DataFrame:
    """E1 end to end: filter -> prompt -> generate -> strip echo -> lines -> questions.
    Filters run before ``mapInArrow`` (Catalyst cannot push through it).
    ``watch(df, stage)`` sees the rows of each stage, to count them."""
    df = abstracts
    if lo is not None or hi is not None:
        df = id_range_filter(df, lo, hi, id_col)
    df = watch(df, "abstracts")
    df = watch(render_prompt(drop_blank(df, "abstract"), template, {"abstract": "abstract"}), "prompts")
    df = watch(generate_text(df, make_generator, "prompt", on_error=on_error), "responses")
    df = watch(explode_lines(strip_echo(df), "response"), "lines")
    return watch(questions(df, "line", numbering).select("url", "research_question"), "questions")


def combine_abstracts(dfs: Sequence[DataFrame], order_by, id_col: str = "id", start: int = 1) -> DataFrame:
    """Union per-source abstract tables and renumber consecutively."""
    u = dfs[0]
    for d in dfs[1:]:
        u = u.unionByName(d, allowMissingColumns=True)
    if id_col in u.columns:
        u = u.withColumnRenamed(id_col, f"source_{id_col}")
    return assign_ids(u, order_by, start, id_col)
