"""Template extraction: entity chunks -> ``EC<n>``, predicate chunks -> ``PC<n>``
(C1-C10, P1-P6, T1-T4).

Each question is independent, so the whole extraction is row-local and needs
no shuffle.  With the default annotator or a small lexicon table a text goes
through ``extract.Extractor`` in a Python worker; the tokens of any other
annotator are worked on as Columns (higher-order functions ``transform``,
``filter``, ``aggregate``) by the steps of this module.  Spans are spliced in text order, overlaps dropped, markers
numbered in text order; a predicate chunk's detached auxiliary shares its
number, and ``the thing`` inside a longer chunk takes two numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qtemplates.functions.prefix import prefix_end, starter_flags
from qtemplates.functions.text import py_strip
from qtemplates.operators.annotate import ISLAND_TAGS, default_letters, let, tag_spans, tags_of
from qtemplates.operators.extract import extracted
from qtemplates.session import cut_lineage
from qtemplates.sources.io import DEFAULT_PREFIXES

# Texts never turned into an entity chunk (lower-cased, stripped).
REJECT_EC = [
    "does", "do", "can", "could", "will", "would", "should", "shall", "may", "might",
    "what", "which", "when", "where", "who", "whom", "whose", "why", "how",
    "type", "types", "kinds", "kind", "category", "categories", "difference",
    "differences", "extent", "i", "we", "respect", "there", "this", "that", "these", "those",
    "not", "the main types", "the possible types", "the types",
    "the difference", "the differences", "the main categories",
    "is", "are", "was", "were", "have", "has", "had", "been", "being", "be",
    "how can", "what can", "when can", "where can", "why can", "which can",
]
# Extra entity rejections of the mapping profile.
REJECT_EC_MAPPING_EXTRA = ["the performance", "the use", "the context", "the accuracy", "terms", "it", "impact"]

# Texts never turned into a predicate chunk.
REJECT_PC = [
    "is", "are", "was", "were", "do", "does", "did", "have", "had", "has", "can", "could", "will", "would",
    "should", "shall", "may", "might", "must", "be", "been", "being", "categorise", "regarding",
    "is of", "are of", "are in", "given", "is there", "are there", "was there", "were there",
]
# Extra predicate rejections of the mapping profile.
REJECT_PC_MAPPING_EXTRA = [
    "using", "compared to", "affect", "improving", "improve", "based on", "incorporating", "impact",
    "used", "achieve", "identifying", "considering", "compare to",
]

# Leading words dropped from an entity chunk; auxiliaries that
# are never a one-token chunk at the start; copulas before a final verb.
LEADING_QUANTIFIERS = ["any", "some", "many", "well", "its"]
LEADING_AUX = ["do", "does", "can", "could", "will", "would", "should", "is", "are", "was", "were"]
FINAL_COPULA = ["are", "is", "were", "was"]

SPAN_TYPE = "array<struct<b:int,e:int,kind:int,v:string,num:int>>"
ENTRY_TYPE = "array<struct<k:string,v:string>>"
KEPT_TYPE = "array<struct<b:int,e:int,kind:int,num:int,marker:string>>"
_PLACED_TYPE = "array<struct<from:int,b:int,e:int,kind:int,num:int,v:string>>"
_WORK_TOKEN = "array<struct<i:int,idx:int,text:string,pos:string,dep:string,h0:int>>"


def _profile_lists(profile: str):
    if profile == "mapping":
        return REJECT_EC + REJECT_EC_MAPPING_EXTRA, REJECT_PC + REJECT_PC_MAPPING_EXTRA
    if profile == "fast":
        return REJECT_EC, REJECT_PC
    raise ValueError("profile must be 'mapping' or 'fast'")


class _Doc:
    """Column helpers over one row's token array.  Per-row constants (prefix
    end, starter flags) live in ``ctx``, a lambda variable bound once per row
    with ``let``, so lambdas over chunks or islands do not re-evaluate them."""

    def __init__(self, tokens: Column, ctx: Column):
        self.t = tokens
        self.c = ctx
        self.n = ctx["n"]
        self.pe = ctx["pe"]

    @staticmethod
    def context(tokens: Column, pe: Column) -> Column:
        n = F.size(tokens)
        w0 = F.lower(F.get(tokens, 0)["text"])
        w1 = F.lower(F.get(tokens, 1)["text"])
        sw0, pair = starter_flags(w0, w1, n)
        return F.struct(pe.cast("int").alias("pe"), n.alias("n"), sw0.alias("sw0"), pair.alias("pair"))

    def tok(self, i) -> Column:
        return F.get(self.t, i)

    @staticmethod
    def end(t: Column) -> Column:
        return (t["idx"] + F.length(t["text"])).cast("int")

    def starter(self, i) -> Column:
        return ((i == 0) & self.c["sw0"]) | ((i <= 1) & self.c["pair"])

    def starter_in(self, s, e_incl) -> Column:
        """Any starter token among token indices [s, e_incl] (only 0 and 1 can be)."""
        return (((s <= 0) & (e_incl >= 0) & self.starter(F.lit(0))) |
                ((s <= 1) & (e_incl >= 1) & self.starter(F.lit(1))))


def _span(b, e, kind, v, num=None) -> Column:
    return F.struct(b.cast("int").alias("b"), e.cast("int").alias("e"), F.lit(kind).cast("int").alias("kind")
                    if isinstance(kind, int) else kind.cast("int").alias("kind"),
                    v.cast("string").alias("v"),
                    (F.lit(None) if num is None else num).cast("int").alias("num"))


#: Characters of a block of a text, as a power of two.
_BLOCK_BITS = 8
_BLOCK = 1 << _BLOCK_BITS


def _blocks(text: Column) -> Column:
    """A text in blocks, so that a cut does not count its characters from the start."""
    return F.when(F.length(text) <= _BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)))


def _cut(blocks: Column, b: Column, e: Column) -> Column:
    """Characters b..e-1 of a text given in blocks."""
    first, last = F.shiftright(b, _BLOCK_BITS), F.shiftright(e, _BLOCK_BITS)
    part = F.when(first == last, F.coalesce(F.get(blocks, first), F.lit(""))).otherwise(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""))
    return F.substr(part, b - first * _BLOCK + 1, e - b)


def blocked_fold(arr: Column, init: Column, step, out_type: str) -> Column:
    """What ``step(state, x)`` -> (state, array of out) emits over an array.
    Appending copies what is there, so each block of about the square root of
    the size collects its own and the blocks are joined at the end."""
    def fold(acc, x):
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def block(acc, part):
        own = F.aggregate(part, F.struct(acc["state"].alias("state"), F.array().cast(out_type).alias("out")), fold)
        return let(own, lambda o: F.struct(o["state"].alias("state"), F.concat(acc["outs"], F.array(o["out"])).alias("outs")))

    def blocked(x):
        width = F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int")
        parts = F.transform(F.sequence(F.lit(1), F.size(x), width), lambda i: F.slice(x, i, width))
        return F.flatten(F.aggregate(parts, F.struct(init.alias("state"), F.array().cast(f"array<{out_type}>").alias("outs")), block, lambda acc: acc["outs"]))
    return let(arr, lambda x: F.when(F.size(x) == 0, F.array().cast(out_type)).otherwise(blocked(x)))


def _in_order(arr: Column, follows) -> Column:
    """Does every element but the first follow the one before it?"""
    return F.coalesce(F.forall(F.transform(arr, lambda x, i: (i == 0) | follows(x, F.get(arr, i - 1))), lambda ok: ok), F.lit(False))


def _by_start(arr: Column) -> Column:
    """Spans by start; those with one start stay in the given order."""
    def ordered(a):
        keyed = F.transform(a, lambda x, i: F.struct(x["b"].alias("b"), i.alias("i"), x.alias("x")))
        return F.when(_in_order(a, lambda x, before: x["b"] >= before["b"]), a).otherwise(F.transform(F.sort_array(keyed), lambda k: k["x"]))
    return let(arr, ordered)


def _by_head(tokens: Column) -> Column:
    """Auxiliaries ordered by the token they depend on: struct of ``aux``
    (head, i, token) and ``lo``, for each token the number of auxiliaries whose
    head is an earlier one - so those of a range are a slice of ``aux``."""
    aux = F.sort_array(F.transform(F.filter(tokens, lambda t: (t["dep"] == "aux") & (t["head"] >= 0) & (t["head"] < F.size(tokens))),
                                   lambda t: F.struct(t["head"].alias("head"), t["i"].alias("i"), t.alias("t"))))

    def counted(a):
        head = lambda k: F.coalesce(F.get(a, k)["head"], F.lit(-1))
        steps = F.transform(a, lambda x, k: F.array_repeat(k, F.when(k == 0, x["head"] + 1).otherwise(x["head"] - head(k - 1))))
        last = F.size(tokens) - F.when(F.size(a) == 0, F.lit(-1)).otherwise(head(F.size(a) - 1))
        return F.struct(a.alias("aux"), F.concat(F.flatten(steps), F.array_repeat(F.size(a), last)).alias("lo"))
    return let(aux, counted)


def ec_spans(q: Column, tokens: Column, chunks: Column, pe: Column, profile: str = "mapping") -> Column:
    """Entity spans (char offsets) in text order, before splicing."""
    return let(_Doc.context(tokens, pe), lambda ctx: let(_blocks(q), lambda text: _ec_spans(text, tokens, chunks, ctx, profile)))


def _ec_spans(text: Column, tokens: Column, chunks: Column, ctx: Column, profile: str) -> Column:
    reject, _ = _profile_lists(profile)
    d = _Doc(tokens, ctx)
    pe = d.pe
    empty = F.array().cast(SPAN_TYPE)
    t0, t1, t2 = d.tok(0), d.tok(1), d.tok(2)
    # How + ADJ + VERB -> the adjective is an entity (no further checks)
    c7 = F.when((d.n > 2) & (F.lower(t0["text"]) == "how") & (t1["pos"] == "ADJ") & (t2["pos"] == "VERB"),
                F.array(_span(t1["idx"], d.end(t1), 1, t1["text"]))).otherwise(empty)

    # staged transforms: each stage materialises its fields once, so later
    # stages read them instead of re-evaluating nested expressions
    def clean1(c):                                                               # C2
        s, e = c["start"], c["end"]
        first = F.lower(d.tok(s)["text"])
        s1 = F.when(((e - s > 1) & first.startswith("wh")) | (first == "how"), s + 1).otherwise(s)
        return F.struct(s.alias("s"), e.alias("e"), s1.alias("s1"))

    def clean2(c):
        s1, e = c["s1"], c["e"]
        s2 = F.when((s1 < e) & F.lower(d.tok(s1)["text"]).isin(LEADING_QUANTIFIERS), s1 + 1).otherwise(s1)
        return F.struct(c["s"].alias("s"), e.alias("e"), s2.alias("s2"))

    def offsets(c):
        b, ee = d.tok(c["s2"])["idx"], d.end(d.tok(c["e"] - 1))
        txt = _cut(text, b, ee)
        return F.struct(c["s"].alias("s"), c["e"].alias("e"), c["s2"].alias("s2"), b.alias("b"), ee.alias("ee"),
                        txt.alias("txt"), py_strip(txt).alias("stxt"))

    def chunk_span(c):
        s, e, s2, b, ee, stxt = c["s"], c["e"], c["s2"], c["b"], c["ee"], c["stxt"]
        ok = ((s2 < e) & (pe.isNull() | (b >= pe))                                   # C3
              & (stxt != "") & ~F.lower(stxt).isin(reject)                           # C4
              & ~d.starter_in(s2, e - 1)                                             # C5
              & ~((s == 0) & (e - s == 1) & d.tok(0)["pos"].isin("AUX", "VERB")      # C6
                  & F.lower(d.tok(0)["text"]).isin(LEADING_AUX)))
        thing = stxt.contains("the thing") & (ee - b > 9)                             # C8
        return _span(F.when(ok, b), ee, F.when(thing, 2).otherwise(1), c["txt"])

    staged = F.transform(F.transform(F.transform(chunks, clean1), clean2), offsets)
    cs = F.filter(F.transform(staged, chunk_span), lambda x: x["b"].isNotNull())
    # Sentence-final quality
    last, pen, ante = d.tok(d.n - 1), d.tok(d.n - 2), d.tok(d.n - 3)
    final = ((d.n >= 2)
             & (((pen["pos"] == "VERB") & (d.n >= 3) & ante["text"].isin(FINAL_COPULA) & (last["text"] == "?"))
                | (pen["pos"].isin("ADJ", "ADV") & (last["text"] == "?")))
             & ~F.lower(pen["text"]).isin(reject) & ~d.starter(d.n - 2))
    c9 = F.when(F.coalesce(final, F.lit(False)),
                F.array(_span(pen["idx"], d.end(pen), 1, pen["text"]))).otherwise(empty)
    return _by_start(F.concat(c7, cs, c9))


def pc_islands(tokens: Column, tags: Column | None = None) -> Column:
    """P1 + P2: predicate spans as token ranges [s, e] (inclusive); ``tags``,
    if known, are the tokens' letters.

    An island is a maximal run of PART|VERB.  Followed by ADJ/ADV+ then ADP,
    or directly by ADP, the span runs through the ADP; otherwise it ends at
    the island's last VERB (none -> no span).  One span per island."""
    spans = tag_spans(tags_of(tokens) if tags is None else tags, ISLAND_TAGS)
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (x["e"] - 1).cast("int").alias("e")))


def pc_spans(q: Column, tokens: Column, pe: Column, profile: str = "mapping", tags: Column | None = None) -> Column:
    """Checked predicate spans numbered in text order, plus their
    auxiliaries (kind 0, same number), sorted by start."""
    return let(_Doc.context(tokens, pe), lambda ctx: let(_blocks(q), lambda text: _pc_spans(text, tokens, ctx, profile, tags)))


def _pc_spans(text: Column, tokens: Column, ctx: Column, profile: str, tags: Column | None) -> Column:
    _, reject = _profile_lists(profile)
    d = _Doc(tokens, ctx)
    pe = d.pe

    def locate(sp, by_head):
        s, e = sp["s"], sp["e"]
        b, ee = d.tok(s)["idx"], d.end(d.tok(e))
        txt = _cut(text, b, ee)
        lo, hi = F.get(by_head["lo"], s), F.get(by_head["lo"], e + 1)
        own = F.filter(F.slice(by_head["aux"], lo + 1, hi - lo), lambda a: (a["i"] < s) | (a["i"] > e))
        aux = F.when(hi > lo, F.array_max(F.transform(own, lambda a: F.struct(a["i"].alias("i"), a["t"].alias("t"))))["t"])
        return F.struct(s.alias("s"), e.alias("e"), b.alias("b"), ee.alias("ee"), txt.alias("txt"),
                        py_strip(txt).alias("stxt"), aux.alias("aux"))

    def main(x):
        s, e, b, stxt, aux = x["s"], x["e"], x["b"], x["stxt"], x["aux"]
        ok = ((pe.isNull() | (b >= pe)) & (stxt != "") & ~F.lower(stxt).isin(reject) & ~d.starter_in(s, e))
        aux_ok = F.coalesce(aux.isNotNull() & ~F.lower(aux["text"]).isin(reject) & ~d.starter(aux["i"]), F.lit(False))
        return F.struct(F.when(ok, b).alias("b"), x["ee"].alias("e"), x["txt"].alias("v"),
                        F.when(aux_ok, aux["idx"]).alias("ab"),
                        F.when(aux_ok, d.end(aux)).alias("ae"))

    located = let(_by_head(tokens), lambda by_head: F.transform(pc_islands(tokens, tags), lambda sp: locate(sp, by_head)))
    mains = F.filter(F.transform(located, main), lambda x: x["b"].isNotNull())

    def spans(numbered):
        main_spans = F.transform(numbered, lambda m: _span(m["b"], m["e"], 1, m["v"], m["num"]))
        aux_spans = F.transform(F.filter(numbered, lambda m: m["ab"].isNotNull()),
                                lambda m: _span(m["ab"], m["ae"], 0, F.lit(None), m["num"]))
        return _by_start(F.concat(main_spans, aux_spans))
    return let(F.transform(mains, lambda m, i: m.withField("num", (i + 1).cast("int"))), spans)


def splice(q: Column, spans: Column, prefix: str, renumber: bool) -> Column:
    """Replace start-sorted spans by markers in one fold; a span
    overlapping the previous kept one is dropped.  Returns
    struct(text STRING, map MAP<STRING,STRING>, kept ARRAY<spliced span>).  ``renumber``: number in
    fold order (entities); otherwise use each span's ``num`` (predicates).
    kind 2 = two markers (``the``/``thing``), kind 0 = marker without a map entry."""
    # the fold only decides which spans stay and their numbers; the text is
    # put together from the pieces between them afterwards
    init = F.struct(F.lit(0).alias("pos"), F.lit(1).alias("num"))

    def step(acc, s):
        skip = s["b"] < acc["pos"]
        state = F.struct(F.when(skip, acc["pos"]).otherwise(s["e"]).alias("pos"),
                         F.when(skip, acc["num"]).otherwise(acc["num"] + F.greatest(s["kind"], F.lit(1))).alias("num"))
        return state, F.when(skip, F.array().cast(_PLACED_TYPE)).otherwise(F.array(F.struct(
            acc["pos"].alias("from"), s["b"].alias("b"), s["e"].alias("e"), s["kind"].alias("kind"),
            (acc["num"] if renumber else s["num"]).cast("int").alias("num"), s["v"].alias("v"))))

    def marked(x):
        k1 = F.concat(F.lit(prefix), x["num"].cast("string"))
        k2 = F.concat(F.lit(prefix), (x["num"] + 1).cast("string"))
        entries = (F.when(x["kind"] == 2, F.array(F.struct(k1.alias("k"), F.lit("the").alias("v")),
                                                  F.struct(k2.alias("k"), F.lit("thing").alias("v"))))
                    .when(x["kind"] == 1, F.array(F.struct(k1.alias("k"), x["v"].alias("v"))))
                    .otherwise(F.array().cast(ENTRY_TYPE)))
        return F.struct(x.alias("x"), F.when(x["kind"] == 2, F.concat(k1, F.lit(" "), k2)).otherwise(k1).alias("marker"), entries.alias("ent"))

    def finish(m, text):
        kept = F.transform(m, lambda y: F.struct(
            y["x"]["b"].alias("b"), y["x"]["e"].alias("e"), y["x"]["kind"].alias("kind"), y["x"]["num"].alias("num"), y["marker"].alias("marker")))
        pieces = F.transform(m, lambda y: F.concat(_cut(text, y["x"]["from"], y["x"]["b"]), y["marker"]))
        end = F.when(F.size(m) > 0, F.get(m, F.size(m) - 1)["x"]["e"]).otherwise(0)
        return F.struct(F.concat(F.array_join(pieces, ""), F.substr(q, end + 1)).alias("text"),
                        F.map_from_entries(F.flatten(F.transform(m, lambda y: y["ent"]))).alias("map"), kept.alias("kept"))
    def apart(sp):
        """All spans where none overlaps the one before: nothing to drop."""
        return F.transform(sp, lambda s, i: F.struct(
            F.when(i == 0, 0).otherwise(F.get(sp, i - 1)["e"]).alias("from"), s["b"].alias("b"), s["e"].alias("e"), s["kind"].alias("kind"),
            (i + 1 if renumber else s["num"]).cast("int").alias("num"), s["v"].alias("v")))

    def placed(sp):
        free = _in_order(sp, lambda s, before: s["b"] >= before["e"])
        single = F.forall(sp, lambda s: s["kind"] <= 1) if renumber else F.lit(True)
        return F.transform(F.when(free & single, apart(sp)).otherwise(blocked_fold(sp, init, step, _PLACED_TYPE)), marked)
    return let(let(spans, placed), lambda m: let(_blocks(q), lambda text: finish(m, text)))


def collapse_spans(tokens: Column, kept: Column) -> Column:
    """Second-pass annotation without re-annotating: tokens inside a spliced
    entity span become one PROPN marker token (two for ``the thing``), other
    tokens keep tag and dependency, offsets shift by the length change of the
    spans before them, heads are remapped to the new positions.  One fold.

    Worth it with a caller-supplied annotator (saves the second Python pass);
    with the default lexicon tagger re-tagging is cheaper (measured at sf0.1:
    27 s re-tagged vs 31 s collapsed), so ``reannotate=True`` is the default."""
    init = F.struct(F.lit(0).alias("n"), F.lit(1).alias("k"), F.lit(0).alias("shift"))

    def step(acc, t):
        # state: tokens so far, the span at hand (from 1), the shift of offsets
        cur = F.try_element_at(kept, acc["k"])
        k = F.when(cur.isNotNull() & (cur["e"] <= t["idx"]), acc["k"] + 1).otherwise(acc["k"])
        sp = F.try_element_at(kept, k)
        inside = F.coalesce(sp.isNotNull() & (sp["b"] <= t["idx"]) & (t["idx"] < sp["e"]), F.lit(False))
        start = inside & (sp["b"] == t["idx"])
        m1 = F.concat(F.lit("EC"), sp["num"].cast("string"))
        m2 = F.concat(F.lit("EC"), (sp["num"] + 1).cast("string"))

        def tok(i, idx, text, pos, dep, h0):
            return F.struct(i.cast("int").alias("i"), idx.cast("int").alias("idx"), text.alias("text"),
                            F.lit(pos).alias("pos") if isinstance(pos, str) else pos.alias("pos"),
                            F.lit(dep).alias("dep") if isinstance(dep, str) else dep.alias("dep"),
                            h0.cast("int").alias("h0"))
        n, at, width = acc["n"], sp["b"] + acc["shift"], F.when(sp["kind"] == 2, 2).otherwise(1)
        marks = F.when(sp["kind"] == 2, F.array(
            tok(n, at, m1, "PROPN", "", F.lit(-1)),
            tok(n + 1, at + F.length(m1) + 1, m2, "PROPN", "", F.lit(-1)))) \
            .otherwise(F.array(tok(n, at, m1, "PROPN", "", F.lit(-1))))
        plain = F.array(tok(n, t["idx"] + acc["shift"], t["text"], t["pos"], t["dep"], t["head"]))
        out = F.when(start, marks).when(inside, F.array().cast(_WORK_TOKEN)).otherwise(plain)
        new_i = F.when(start | ~inside, n).otherwise(n - width)
        state = F.struct(F.when(start, n + width).when(inside, n).otherwise(n + 1).cast("int").alias("n"), k.alias("k"),
                         F.when(start, acc["shift"] + F.length(sp["marker"]) - (sp["e"] - sp["b"])).otherwise(acc["shift"]).cast("int").alias("shift"))
        return state, F.array(F.struct(out.alias("out"), new_i.cast("int").alias("at")))

    def finish(moved):
        at = F.transform(moved, lambda x: x["at"])
        out = F.flatten(F.transform(moved, lambda x: x["out"]))
        return let(at, lambda nidx: F.transform(out, lambda t: F.struct(
            t["i"].alias("i"), t["idx"].alias("idx"), t["text"].alias("text"), t["pos"].alias("pos"), t["dep"].alias("dep"),
            F.when(t["h0"] < 0, t["i"]).otherwise(F.coalesce(F.get(nidx, t["h0"]), t["i"])).cast("int").alias("head"))))
    return let(blocked_fold(tokens, init, step, f"array<struct<out:{_WORK_TOKEN},at:int>>"), finish)


def _annotated(df: DataFrame, text_col: str, tok: str, ch: str, tags: str, annotator) -> DataFrame:
    out = annotator(df, text_col, tok, ch)
    return out.withColumn(tags, tags_of(F.col(tok)))


def _word_list(annotator) -> dict[str, str] | None:
    """The listed words of an annotator that is the default tagger with those
    words, else None."""
    if annotator is None:
        return default_letters()
    listed = getattr(annotator, "listed", None)
    return listed() if listed else None


def _extracted(df: DataFrame, q_col: str, profile: str, prefixes: Sequence[str] | None, annotator, reannotate: bool, mapping: bool) -> DataFrame:
    prefixes = list(prefixes) if prefixes is not None else list(DEFAULT_PREFIXES)
    lists = _profile_lists(profile)
    listed = _word_list(annotator)
    if listed is not None:
        x = df.withColumn("_x", extracted(py_strip(q_col), listed, prefixes, lists, reannotate, mapping)).withColumn("templated_question", F.col("_x.text"))
        return (x.withColumn("mapping", F.col("_x.map")) if mapping else x).drop("_x")
    x = df.withColumn("_q", py_strip(q_col))
    x = _annotated(x, "_q", "_t1", "_c1", "_g1", annotator)
    x = x.withColumn("_ec", splice(F.col("_q"), ec_spans(F.col("_q"), F.col("_t1"), F.col("_c1"),
                                                           prefix_end(F.col("_q"), prefixes, stripped=True), profile), "EC", True))
    x = x.withColumn("_q2", F.col("_ec.text"))
    if reannotate:
        x = _annotated(x, "_q2", "_t2", "_c2", "_g2", annotator)
    else:   # derive the second annotation from the first (no second tagging pass)
        x = x.withColumn("_t2", collapse_spans(F.col("_t1"), F.col("_ec.kept"))).withColumn("_c2", F.lit(None)).withColumn("_g2", tags_of(F.col("_t2")))
    x = x.withColumn("_pc", splice(F.col("_q2"), pc_spans(F.col("_q2"), F.col("_t2"),
                                                            prefix_end(F.col("_q2"), prefixes, stripped=True), profile, F.col("_g2")), "PC", False))
    x = x.withColumn("templated_question", F.col("_pc.text"))
    if mapping:
        x = x.withColumn("mapping", F.map_concat(F.col("_ec.map"), F.col("_pc.map")))
    return x.drop("_q", "_t1", "_c1", "_g1", "_ec", "_q2", "_t2", "_c2", "_g2", "_pc")


def extract_template_with_mapping(df: DataFrame, q_col: str = "research_question", profile: str = "mapping",
                                  prefixes: Sequence[str] | None = None, annotator=None,
                                  reannotate: bool = True) -> DataFrame:
    """T2 (and T1 with ``profile='fast'``): adds ``templated_question`` and
    ``mapping`` (MAP marker -> chunk text).  ``annotator(df, text_col,
    tokens_col, chunks_col)`` defaults to the lexicon tagger; it is applied to
    the question and again to the entity-marked text, or, with
    ``reannotate=False``, the second annotation is the first with the entity
    spans collapsed into marker tokens (``collapse_spans``)."""
    return _extracted(df, q_col, profile, prefixes, annotator, reannotate, True)


def extract_template(df: DataFrame, q_col: str = "research_question", prefixes=None, annotator=None,
                     reannotate: bool = True) -> DataFrame:
    """Template only, fast profile."""
    return _extracted(df, q_col, "fast", prefixes, annotator, reannotate, False)


def expand_markers(df: DataFrame, ec: int = 5, pc: int = 2, map_col: str = "mapping") -> DataFrame:
    """Wide EC1..ECec, PC1..PCpc columns, '' when missing."""
    cols = [F.coalesce(F.try_element_at(F.col(map_col), F.lit(f"EC{i}")), F.lit("")).alias(f"EC{i}")
            for i in range(1, ec + 1)]
    cols += [F.coalesce(F.try_element_at(F.col(map_col), F.lit(f"PC{i}")), F.lit("")).alias(f"PC{i}")
             for i in range(1, pc + 1)]
    return df.select("*", *cols)


def order_templates(df: DataFrame, col: str = "templated_question", tie: str | None = None) -> DataFrame:
    """T4: by template length, then text.  ``tie`` (e.g. the unique question)
    makes the order total, so a template shared by many questions can be
    split across range partitions instead of landing in one."""
    keys = [F.length(col), F.col(col)] + ([F.col(tie)] if tie else [])
    return df.orderBy(*keys)


def templates_from_questions(questions: DataFrame, q_col: str = "research_question", prefixes=None,
                             annotator=None) -> DataFrame:
    """F4 -> T2 -> T4: question, template and the whole marker map;
    ``wide_templates`` makes the marker columns of it."""
    # copies of a question collapse before the shuffle; the distinct ones are
    # then dealt out by an explicit count, as the chunking below is CPU-heavy
    # and adaptive execution would judge by bytes
    spark = questions.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        n = max(n, 4 * spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001  (Spark Connect: no context)
        pass
    q = questions.select(q_col).na.drop().dropDuplicates().repartition(n, q_col)
    t = extract_template_with_mapping(q, q_col, "mapping", prefixes, annotator)
    # the range sort samples its input first; cut lineage so the sampling job
    # reads the written templates instead of re-running the extraction
    return order_templates(cut_lineage(t.select(q_col, "templated_question", "mapping"), "templates"), tie=q_col)


def wide_templates(templates: DataFrame, ec: int = 5, pc: int = 2) -> DataFrame:
    """T3 view of ``templates_from_questions``: EC1..ECec and PC1..PCpc
    columns instead of the map."""
    return expand_markers(templates, ec, pc).drop("mapping")
