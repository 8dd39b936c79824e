"""Annotation with a lexicon table (A1): a user's words instead of the plan's.

A lexicon has ``word`` (lower-cased), ``pos`` and ``noun_after`` (a verb that
is a noun directly after a determiner or adjective), one row a word, and any
number of rows: the texts' tokens meet it in a join, which Spark broadcasts
only if the table is small enough; a lexicon of at most ``INLINED`` words is
written into the plan, and nothing is shuffled.  Words that
are not listed get their tag by form, as in ``annotate``: punctuation, marker,
digits, then suffix.  With ``default_lexicon`` the result is that of
``annotate``.

Cases: a null text has null annotations, one without tokens empty ones; of
several rows for a word the first by tag counts; a tag that is not one of
``LETTERS`` is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qtemplates.operators import annotate as A
from qtemplates.session import cut_lineage

SCHEMA = "word string, pos string, noun_after boolean"


def default_lexicon(spark: SparkSession) -> DataFrame:
    """The closed-class words and the verb list of the default tagger."""
    listed = [(A.DET, "DET"), (A.ADP, "ADP"), (A.PART, "PART"), (A.AUX, "AUX"), (A.PRON, "PRON"), (A.CCONJ, "CCONJ"), (A.SCONJ, "SCONJ")]
    rows = [(w, tag, False) for words, tag in listed for w in words] + [(w, "VERB", True) for w in A.VERB_WORDS]
    return spark.createDataFrame(rows, SCHEMA)


def extend_lexicon(base: DataFrame, own: DataFrame) -> DataFrame:
    """``own`` and the rows of ``base`` for all other words."""
    return base.join(own.select("word"), "word", "left_anti").unionByName(own.select("word", "pos", "noun_after"))


def _letter(pos: Column) -> Column:
    out = F.raise_error(F.concat(F.lit("unknown tag in the lexicon: "), pos)).cast("string")
    for tag, c in A.LETTERS.items():
        out = F.when(pos == tag, c).otherwise(out)
    return out


def _by_form(t: Column, w: Column) -> Column:
    """The letter of a word that is not listed."""
    return (F.when(t.rlike(r"^(?:EC|PC)[0-9]+\z"), A.LETTERS["PROPN"]).when(w.rlike(r"^[0-9]+\z"), A.LETTERS["NUM"]).when(w.endswith("ly"), A.LETTERS["ADV"])
            .when(w.rlike(r"(?:al|ive|ous|able|ible|ful|ic)\z"), A.LETTERS["ADJ"]).when(w.rlike(r"(?:ing|ed|ize|ise)\z"), A.LETTERS["VERB"]).otherwise(A.LETTERS["NOUN"]))


#: Words of a lexicon that is written into the plan instead of joined.
INLINED = 1000


def _letters(lexicon: DataFrame) -> DataFrame:
    """word and ``listed``, its letter."""
    return (lexicon.groupBy("word").agg(F.min(F.struct("pos", F.coalesce("noun_after", F.lit(False)).alias("after"))).alias("own"))
            .select("word", F.when((F.col("own.pos") == "VERB") & F.col("own.after"), A._LISTED_VERB).otherwise(_letter(F.col("own.pos"))).alias("listed")))


def _inlined(words: DataFrame) -> dict[str, str] | None:
    """The letters of a lexicon of at most ``INLINED`` words, else None."""
    rows = words.filter(F.col("word").isNotNull()).limit(INLINED + 1).collect()
    return {r["word"]: r["listed"] for r in rows} if len(rows) <= INLINED and all(r["listed"] for r in rows) else None


def annotate_with_lexicon(df: DataFrame, text_col: str, lexicon: DataFrame, tokens_col: str = "tokens", chunks_col: str = "noun_chunks") -> DataFrame:
    """A1: adds ``tokens`` and ``noun_chunks`` by the words of ``lexicon``."""
    words = _letters(lexicon)
    listed = _inlined(words)
    if listed is not None:
        return A.annotate(df, text_col, tokens_col, chunks_col, listed=listed)
    return _joined(df, text_col, words, tokens_col, chunks_col)


def _joined(df: DataFrame, text_col: str, words: DataFrame, tokens_col: str, chunks_col: str) -> DataFrame:
    """Annotation by a lexicon of any size.  Tokens travel as the number of
    their row, their place and their word; what comes back to a row is its
    string of tags, from which its tokens are made where the text is."""
    rows = cut_lineage(df.withColumn("_id", F.monotonically_increasing_id()), "lexicon-texts")
    each = rows.select("_id", F.posexplode(F.regexp_extract_all(text_col, F.lit(A.TOKEN_PATTERN), 1)).alias("i", "t"))
    # punctuation, markers and numbers are what they look like, whatever is listed
    shaped = ~F.col("t").rlike(r"[\p{L}\p{N}]")
    fixed = F.col("t").rlike(r"^(?:EC|PC)[0-9]+\z") | F.col("t").rlike(r"^[0-9]+\z")
    form = F.when(shaped, A.LETTERS["PUNCT"]).otherwise(_by_form(F.col("t"), F.lower("t")))
    each = each.select("_id", "i", form.alias("form"), F.when(~shaped & ~fixed, F.lower("t")).alias("w"))
    tagged = each.join(words, F.col("w") == F.col("word"), "left")
    # a token's place and its letter's code in one number
    coded = tagged.select("_id", (F.col("i").cast("long") * 128 + F.ascii(F.coalesce("listed", "form"))).alias("x"))
    letters = F.array_join(F.transform(F.sort_array("x"), lambda x: F.char(x % 128)), "")
    tags = coded.groupBy("_id").agg(F.collect_list("x").alias("x")).select("_id", A.in_context(letters).alias("_tags"))
    out = rows.join(tags, "_id", "left").withColumn("_tags", F.coalesce("_tags", F.lit("")))
    out = out.withColumn("_parsed", A.let(A.placed_words(F.col(text_col)), lambda r: A.structured(r["t"], r["ends"], F.col("_tags"))))
    out = out.withColumn(tokens_col, F.col("_parsed.tokens")).withColumn(chunks_col, F.when(F.col(text_col).isNotNull(), A.noun_chunks(F.col("_parsed.tags"))))
    return out.drop("_id", "_tags", "_parsed")


def lexicon_annotator(lexicon: DataFrame):
    """An annotator for ``extract_template`` and its kin, which ask it for
    ``listed``: the letters of the lexicon's words if they are few, else None."""
    def annotate(df: DataFrame, text_col: str, tokens_col: str, chunks_col: str) -> DataFrame:
        return annotate_with_lexicon(df, text_col, lexicon, tokens_col, chunks_col)
    annotate.listed = lambda: _inlined(_letters(lexicon))
    return annotate
