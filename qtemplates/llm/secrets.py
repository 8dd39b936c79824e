"""Secret scans: fixed patterns plus a character Markov model for random strings.

Base kinds are found by pattern.  The method adds kind ``random``: runs of
``MIN_RANDOM`` or more key characters whose first-order Markov log-likelihood
ratio between random strings and ordinary identifiers reaches ``MIN_RATIO``
nats, unless the run overlaps a base span.  Both models are counted over
labelled samples and hold one number per pair of key characters.

Spans are code points, end exclusive.  Spark has no function for the places of
all matches, so they are the running lengths of the pieces between matches
(``split``) and of the matches (``regexp_extract_all``).

Everything is a row-local DataFrame expression.  Cases: a null text counts as
empty; texts without secrets give empty span lists; repeated rows are scanned
like any others; without samples of both kinds the model adds nothing; an empty
table gives an empty result; only the id and the text are read, so further
columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qtemplates.llm.common import double_array, hashed_sample, let, text_or_empty

#: Base kinds in their order: pattern and, of each match, which one counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
#: Characters of keys; position is the code in the models.
KEY_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_RANDOM = 20
RANDOM = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RANDOM
MIN_RATIO = 10.0
#: Weight of a character's overall frequency against its transitions' counts.
PRIOR = 10.0
#: At most this many labelled documents give samples.
SAMPLE_DOCS = 5_000
MARK = "[SECRET]"


def training_samples(documents: DataFrame, labels: DataFrame, pages: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """(sample, random): labelled strings.  Ordinary ones are words of
    labelled good documents and the parts of page addresses; random ones are
    digests of the same documents in hex and base64, as keys are written."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    good = hashed_sample(good, ["doc_id"], limit)
    texts = documents.join(F.broadcast(good), "doc_id", "left_semi").select(text_or_empty().alias("t"))
    sha = F.sha2(F.col("t"), 256)
    both = F.array(sha, F.regexp_replace(F.base64(F.unhex(sha)), "=+$", ""))
    urls = hashed_sample(pages.select("page_id", "url"), ["page_id"], limit, ["url"]).select(F.coalesce("url", F.lit("")).alias("t"))
    run = F.lit(r"[A-Za-z0-9+/_=-]{4,}")
    pick = lambda df: df.select(F.explode(F.regexp_extract_all("t", run, F.lit(0))).alias("sample"), F.lit(False).alias("random"))
    return pick(texts).unionByName(pick(urls)).unionByName(texts.select(F.explode(both).alias("sample"), F.lit(True).alias("random")))


def fit(samples: DataFrame) -> list[float] | None:
    """Log-likelihood ratios by pair of codes (random over ordinary); None
    without samples of both kinds."""
    n = len(KEY_CHARS)
    pairs = F.transform(F.sequence(F.lit(1), F.length("sample") - 1), lambda i: F.substr(F.col("sample"), i, F.lit(2)))
    rows = (samples.filter(F.length("sample") > 1).select("random", F.explode(pairs).alias("pair"))
            .groupBy("pair").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o")).collect())
    code = {c: i for i, c in enumerate(KEY_CHARS)}
    counts = [[0] * (n * n), [0] * (n * n)]
    for row in rows:  # one row per pair of characters
        a, b = code.get(row["pair"][0]), code.get(row["pair"][1])
        if a is not None and b is not None:
            counts[0][a * n + b] += row["r"]
            counts[1][a * n + b] += row["o"]
    if not all(map(sum, counts)):
        return None
    logs = []
    for c in counts:  # transitions, smoothed by how often the next character occurs at all
        total = sum(c)
        any_ = [(sum(c[b::n]) + 1) / (total + n) for b in range(n)]
        rows = [sum(c[a * n:(a + 1) * n]) for a in range(n)]
        logs.append([math.log((c[k] + PRIOR * any_[k % n]) / (rows[k // n] + PRIOR)) for k in range(n * n)])
    return [r - o for r, o in zip(*logs, strict=True)]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string of key characters."""
    n = len(KEY_CHARS)
    at = F.split(F.lit(",".join(str(KEY_CHARS.find(chr(i))) for i in range(128))), ",").cast("array<int>")
    table = double_array(model)
    codes = F.transform(F.split(token, ""), lambda c: F.get(at, F.ascii(c)))
    return let(codes, lambda k: F.aggregate(
        F.zip_with(F.slice(k, 1, F.greatest(F.size(k) - 1, F.lit(0))), F.slice(k, 2, F.greatest(F.size(k) - 1, F.lit(0))),
                   lambda a, b: F.get(table, a * n + b)), F.lit(0.0), lambda s, x: s + x))


def running(lengths: Column) -> Column:
    """Sums of an array of ints up to each element, that included.  Folded in
    blocks of about the square root of the size, as appending copies."""
    def fold(x, start):
        return F.slice(F.aggregate(x, F.array(start), lambda s, v: F.concat(s, F.array(F.element_at(s, -1) + v))), 2, F.greatest(F.size(x), F.lit(1)))

    def blocked(x):
        step = F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(x), step), lambda i: F.slice(x, i, step))
        total = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, v: s + v))
        before = let(total, lambda t: F.zip_with(fold(t, F.lit(0)), t, lambda s, v: s - v))
        return F.flatten(F.zip_with(blocks, before, fold))
    return let(lengths, lambda x: F.when(F.size(x) == 0, x).otherwise(blocked(x)))


def matches(text: Column, pattern: str, kind: int, keep) -> Column:
    """Array of (start, kind, end) of the matches for which ``keep(match)``."""
    def placed(m):
        pieces = F.slice(F.split(text, pattern, -1), 1, F.size(m))
        ends = running(F.zip_with(pieces, m, lambda p, q: F.length(p) + F.length(q)))
        spans = F.zip_with(ends, m, lambda e, q: F.struct((e - F.length(q)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), keep(q).alias("ok")))
        some = F.filter(spans, lambda s: s["ok"])
        return F.transform(some, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))


def _rules(model: list[float] | None):
    """(pattern, kind, which matches count)."""
    always = lambda m: F.lit(True)
    rules = [(ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12), (ACCESS, 1, always), (HEX, 2, always)]
    return rules + ([(RANDOM, 3, lambda m: ratio(m, model) >= MIN_RATIO)] if model else [])


def _blanked(text: Column, rules) -> Column:
    """The text with the matches of some kinds as spaces, so that what is left
    of a run beside them is a run of its own."""
    if not rules:
        return text
    (pattern, _, keep), rest = rules[0], rules[1:]

    def joined(m):
        shown = F.transform(m, lambda q: F.when(keep(q), F.repeat(F.lit(" "), F.length(q))).otherwise(q))
        return F.array_join(F.flatten(F.zip_with(F.split(text, pattern, -1), shown, lambda p, q: F.array(p, F.coalesce(q, F.lit(""))))), "")
    blanked = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, text).otherwise(joined(m)))
    return let(blanked, lambda t: _blanked(t, rest))


def find(text: Column, model: list[float] | None) -> Column:
    """Struct of ``base`` and ``all``: sorted arrays of (start, kind, end).
    Random runs are sought in what the base spans leave of the text."""
    rules = _rules(model)
    base = F.array_sort(F.concat(*[matches(text, *rule) for rule in rules[:3]]))
    if model is None:
        return let(base, lambda b: F.struct(b.alias("base"), b.alias("all")))
    found = let(_blanked(text, rules[:3]), lambda t: matches(t, *rules[3]))
    extra = lambda b: F.filter(found, lambda s: ~F.exists(b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))
    return let(base, lambda b: F.struct(b.alias("base"), F.array_sort(F.concat(b, extra(b))).alias("all")))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(documents: DataFrame, model: list[float] | None) -> DataFrame:
    """doc_id, spans (array of kind, start, end), counts and digests."""
    found = documents.select("doc_id", find(text_or_empty(), model).alias("f"))
    count = lambda k: F.size(F.filter("f.base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        (F.size("f.all") - F.size("f.base")).cast("long").alias("n_random"),
                        F.sha2(written(F.col("f.base")), 256).alias("base_sha256"), written(F.col("f.all")).alias("spans"))


def redacted(text: Column, model: list[float] | None) -> Column:
    """The text with each secret that ``find`` reports replaced by ``MARK``;
    spans that overlap are replaced by one mark."""
    def step(acc, s):
        new = s["start"] >= acc["pos"]
        part = F.concat(F.substr(text, acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0))), F.lit(MARK))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.concat(acc["out"], F.when(new, part).otherwise("")).alias("out"))

    def joined(spans):
        return F.aggregate(spans, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["pos"] + 1)))
    return let(find(text, model)["all"], lambda spans: F.when(F.size(spans) == 0, text).otherwise(joined(spans)))


def redact(documents: DataFrame, model: list[float] | None) -> DataFrame:
    """All rows and columns; secrets in ``text`` replaced, ``n_chars`` set to
    the new length.  A null text stays null."""
    out = documents.withColumn("text", F.when(F.col("text").isNotNull(), redacted(F.col("text"), model)))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out
