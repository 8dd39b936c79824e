"""Text annotation (A1): tokens with POS, dependency hint and char offsets,
plus noun chunks.

Contract (one row per text):
  tokens      ARRAY<STRUCT<i INT, idx INT, text STRING, pos STRING, dep STRING, head INT>>
  noun_chunks ARRAY<STRUCT<start INT, end INT>>   (token ranges, end exclusive)

The default is a small lexicon tagger written as Column expressions, so it
runs inside whole-stage code generation with no Python worker.  A real
tagger plugs in through ``annotate_with`` (``mapInPandas``; the factory runs
once per Python worker).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qtemplates.session import function_key

TOKEN_TYPE = "array<struct<i:int,idx:int,text:string,pos:string,dep:string,head:int>>"
CHUNK_TYPE = "array<struct<start:int,end:int>>"

TOKEN_PATTERN = r"(?U)([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
GAP_PATTERN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"

# Closed-class words of the default lexicon tagger.
DET = ["a", "an", "the", "this", "that", "these", "those", "any", "some", "what", "which"]
ADP = ["of", "in", "on", "at", "by", "for", "from", "with", "without", "into", "over", "under",
       "between", "through", "across", "against", "as", "about"]
PART = ["to", "not"]
AUX = ["be", "am", "is", "are", "was", "were", "been", "being", "have", "has", "had", "do", "does",
       "did", "can", "could", "will", "would", "should", "shall", "may", "might", "must"]
PRON = ["i", "we", "it", "they", "he", "she", "you", "there"]
CCONJ = ["and", "or", "but"]
SCONJ = ["if", "how", "when", "where", "why", "whether"]
VERB_WORDS = ["use", "used", "using", "improve", "predict", "compare", "measure", "achieve",
              "affect", "go", "based", "trained"]


#: Elements of a block of running sums, as a power of two.
_SUMMED_BITS = 6


def prefix_sums(arr: Column) -> Column:
    """Running sums of an int array.  A fold that appends copies the array so
    far; so a block adds what lies 1, 2, 4, ... elements before, and only the
    blocks' totals, if there are several, are summed up in a fold."""
    last = (1 << _SUMMED_BITS) - 1

    def within(s, step):
        if step > last:
            return joined(s)
        added = F.transform(s, lambda v, i: F.when(i.bitwiseAND(F.lit(last)) >= step, v + F.get(s, i - step)).otherwise(v))
        return let(F.when(F.size(s) > step, added).otherwise(s), lambda y: within(y, 2 * step))

    def joined(s):
        totals = F.transform(F.sequence(F.lit(last), F.size(s) - 1, F.lit(last + 1)), lambda i: F.get(s, i))
        whole = let(_folded_sums(totals), lambda before: F.transform(s, lambda v, i: F.when(i > last, v + F.get(before, F.shiftright(i, _SUMMED_BITS) - 1)).otherwise(v)))
        return F.when(F.size(s) <= last + 1, s).otherwise(whole)
    return let(arr, lambda x: within(x, 1))


def _folded_sums(arr: Column) -> Column:
    """Running sums in a fold over blocks of about the square root of the size."""
    def fold(block, start):
        init = F.array(start.cast("int"))
        sums = F.aggregate(block, init, lambda acc, x: F.concat(acc, F.array((F.element_at(acc, -1) + x).cast("int"))))
        return F.slice(sums, 2, F.greatest(F.size(block), F.lit(1)))

    def blocked(x):
        width = F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(x), width), lambda i: F.slice(x, i, width))
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, v: (acc + v).cast("int")))
        starts = let(totals, lambda t: F.zip_with(fold(t, F.lit(0)), t, lambda upto, own: upto - own))
        return F.flatten(F.zip_with(blocks, starts, fold))
    return let(arr, lambda x: F.when(F.size(x) == 0, x).otherwise(blocked(x)))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda
    variable.  Expressions referenced inside higher-order lambdas are not
    shared, so an array used per element must be bound first, or it is
    recomputed for every element."""
    return F.get(F.transform(F.array(value), body), 0)


#: One letter per tag; the tags of a text are a string of these letters.
LETTERS = {"ADP": "A", "CCONJ": "C", "DET": "D", "ADJ": "J", "NUM": "M", "NOUN": "N", "PROPN": "O", "PART": "P", "PRON": "Q",
           "ADV": "R", "SCONJ": "S", "AUX": "U", "VERB": "V", "PUNCT": "X"}
#: A word of the verb list, until its neighbour is known.
_LISTED_VERB = "W"


#: Noun chunks and predicate islands in a text's tags.
CHUNK_TAGS = "D[JMNO]*[NO]|(?<![DJMNO])[JMNO]*[NO]"
ISLAND_TAGS = "(?<![VP])(?:[VP]++[JR]*+A|[VP]*V)"

#: Suffixes of a word's tag by form, in the order in which they count.
ADV_ENDS = ["ly"]
ADJ_ENDS = ["al", "ive", "ous", "able", "ible", "ful", "ic"]
VERB_ENDS = ["ing", "ed", "ize", "ise"]


def default_letters() -> dict[str, str]:
    """The letter of every listed word."""
    out: dict[str, str] = {}
    for words, tag in [(DET, "DET"), (ADP, "ADP"), (PART, "PART"), (AUX, "AUX"), (PRON, "PRON"), (CCONJ, "CCONJ"), (SCONJ, "SCONJ")]:
        for w in words:
            out.setdefault(w, LETTERS[tag])
    for w in VERB_WORDS:  # the suffixes of adverbs and adjectives come before the verb list
        out.setdefault(w, LETTERS["ADV"] if w.endswith(tuple(ADV_ENDS)) else LETTERS["ADJ"] if w.endswith(tuple(ADJ_ENDS)) else _LISTED_VERB)
    return out


def by_form(w: Column) -> Column:
    """The letter of a lower-cased word by its ending."""
    out = F.when(w.endswith(ADV_ENDS[0]), LETTERS["ADV"])
    for ends, tag in ((ADJ_ENDS, "ADJ"), (VERB_ENDS, "VERB")):
        for e in ends:
            out = out.when(w.endswith(e), LETTERS[tag])
    return out.otherwise(LETTERS["NOUN"])


def letters_of(words: Column, listed: dict[str, str] | None = None) -> Column:
    """Letters that each stand for a token alone, as an array; ``listed`` is
    the letter of each listed word, by default those of the default tagger.

    One lambda over the tokens: the listed words are one hash lookup, the
    suffixes comparisons of bytes; regular expressions run only on tokens that
    begin like a marker or with something else than a-z."""
    own = default_letters() if listed is None else listed
    groups: dict[str, list[str]] = {}
    for w, c in own.items():
        groups.setdefault(c, []).append(w)

    def known(w):
        out = F.lit(None).cast("string")
        for c, ws in groups.items():
            out = F.when(w.isin(ws), c).otherwise(out)
        return out

    def letter(w, i):
        t, first = F.get(words, i), F.ascii(w)
        named = (F.when(w.isin(list(own)), known(w)) if own else F.when(F.lit(False), "")).otherwise(by_form(w))
        other = F.when(~t.rlike(r"[\p{L}\p{N}]"), LETTERS["PUNCT"]).when(w.rlike(r"^[0-9]+\z"), LETTERS["NUM"]).otherwise(named)
        marker = (w.startswith("ec") | w.startswith("pc")) & t.rlike(r"^(?:EC|PC)[0-9]+\z")
        return F.when((first < 97) | (first > 122), other).when(marker, LETTERS["PROPN"]).otherwise(named)
    return let(F.transform(words, F.lower), lambda lowered: F.transform(lowered, letter))


def tag_string(words: Column, listed: dict[str, str] | None = None) -> Column:
    """The tags of a text's tokens as a string of letters."""
    return F.when(F.size(words) == 0, "").otherwise(in_context(F.array_join(letters_of(words, listed), "")))


def in_context(letters: Column) -> Column:
    """Tags from letters that each stand for a token alone: a word of the verb
    list directly after a determiner or adjective is a noun."""
    return F.translate(F.regexp_replace(letters, f"(?<=[DJ]){_LISTED_VERB}", LETTERS["NOUN"]), _LISTED_VERB, LETTERS["VERB"])


def parsed(text: Column, listed: dict[str, str] | None = None) -> Column:
    """The default annotation of one text: struct of ``tokens`` (D11) and
    ``tags``, their letters; ``listed`` as for ``letters_of``."""
    return let(placed_words(text), lambda r: let(tag_string(r["t"], listed), lambda tags: structured(r["t"], r["ends"], tags)))


def placed_words(text: Column) -> Column:
    """Struct of a text's tokens ``t`` and the offsets behind them, ``ends``."""
    raw = F.struct(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 1).alias("t"),
                   F.split(text, GAP_PATTERN, -1).alias("g"))
    sizes = lambda r: F.transform(r["t"], lambda t, i: F.length(F.get(r["g"], i)) + F.length(t))
    return let(raw, lambda r: F.struct(r["t"].alias("t"), prefix_sums(sizes(r)).alias("ends")))


def structured(words: Column, ends: Column, tags: Column) -> Column:
    """Struct of ``tokens`` (D11) and ``tags`` from a text's tokens, the
    offsets behind them and their letters."""
    # an auxiliary or particle with a verb one, two or three tokens on becomes that digit
    a = LETTERS["AUX"] + LETTERS["PART"]
    v = LETTERS["VERB"]
    ahead = tags
    for k in (1, 2, 3):
        ahead = F.regexp_replace(ahead, f"[{a}](?=.{{{k - 1}}}{v})", str(k))
    by_letter = {c: tag for tag, c in LETTERS.items()}
    names = F.split(F.lit(",".join(by_letter.get(chr(65 + k), "") for k in range(26))), ",")

    def build(r):
        def token(t, i):
            code = F.ascii(F.get(r["h"], i))  # a digit is below the letters
            return F.struct(i.cast("int").alias("i"), (F.get(ends, i) - F.length(t)).cast("int").alias("idx"), t.alias("text"),
                            F.get(names, F.ascii(F.get(r["c"], i)) - 65).alias("pos"),
                            F.when(code < 65, "aux").otherwise("").alias("dep"), F.when(code < 65, i + code - 48).otherwise(i).cast("int").alias("head"))
        return F.struct(F.transform(words, token).alias("tokens"), tags.alias("tags"))
    return let(F.struct(F.split(tags, "").alias("c"), F.split(ahead, "").alias("h")), build)


def lexicon_tokens(text: Column) -> Column:
    """The default annotation of one text as a token array."""
    return parsed(text)["tokens"]


def tags_of(tokens: Column) -> Column:
    """The tags of a token array as letters; ``x`` for any other tag."""
    def letter(t):
        p, out = t["pos"], None
        for tag in sorted(LETTERS, key=lambda x: x not in ("NOUN", "DET", "ADP", "VERB")):  # frequent ones first
            out = F.when(p == tag, LETTERS[tag]) if out is None else out.when(p == tag, LETTERS[tag])
        return out.otherwise("x")
    return F.array_join(F.transform(tokens, letter), "")


def tag_spans(tags: Column, pattern: str) -> Column:
    """Token ranges (``s`` inclusive, ``e`` exclusive) where ``pattern`` fits
    a text's tags written as letters; one pass of the regex engine."""
    def placed(r):
        sizes = F.transform(r["found"], lambda m, i: F.length(F.get(r["gaps"], i)) + F.length(m))
        return F.zip_with(prefix_sums(sizes), r["found"], lambda e, m: F.struct((e - F.length(m)).cast("int").alias("s"), e.cast("int").alias("e")))
    return let(tags, lambda t: let(F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found"), F.split(t, pattern, -1).alias("gaps")), placed))


def noun_chunks(tags: Column) -> Column:
    """Default noun chunks: ``DET? (ADJ|NUM|NOUN|PROPN)*`` runs cut after
    their last NOUN/PROPN (a run without one yields no chunk)."""
    spans = tag_spans(tags, CHUNK_TAGS)
    return F.transform(spans, lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end")))


def annotate(df: DataFrame, text_col: str, tokens_col: str = "tokens", chunks_col: str = "noun_chunks", tags_col: str | None = None,
             listed: dict[str, str] | None = None) -> DataFrame:
    """A1 with the default lexicon tagger (no Python worker); ``tags_col``
    also keeps the tags as letters; ``listed`` as for ``letters_of``."""
    out = df.withColumn("_parsed", parsed(F.col(text_col), listed))
    out = out.withColumn(tokens_col, F.col("_parsed.tokens")).withColumn(chunks_col, noun_chunks(F.col("_parsed.tags")))
    return (out.withColumn(tags_col, F.col("_parsed.tags")) if tags_col else out).drop("_parsed")


_ANNOTATORS: dict = {}


def annotate_with(df: DataFrame, text_col: str, make_annotator: Callable[[], Callable[[str], tuple]],
                  tokens_col: str = "tokens", chunks_col: str = "noun_chunks") -> DataFrame:
    """A1 with a caller-supplied annotator.  ``make_annotator()`` returns a
    function text -> (tokens, noun_chunks) in the contract's shape (lists of
    dicts or tuples)."""
    schema = T.StructType(df.schema.fields + [
        T.StructField(tokens_col, T._parse_datatype_string(TOKEN_TYPE)),
        T.StructField(chunks_col, T._parse_datatype_string(CHUNK_TYPE))])
    key = function_key(make_annotator)

    def run(batches: Iterable):
        # built once per Python worker (workers are reused across tasks)
        from qtemplates.operators import annotate as mod   # the worker's module, not a pickled copy
        fn = mod._ANNOTATORS.get(key)
        if fn is None:
            fn = mod._ANNOTATORS[key] = make_annotator()
        for pdf in batches:
            res = [fn(t) if t is not None else ([], []) for t in pdf[text_col]]
            yield pdf.assign(**{tokens_col: [r[0] for r in res], chunks_col: [r[1] for r in res]})
    return df.mapInPandas(run, schema)
