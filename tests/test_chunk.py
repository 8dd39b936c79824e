"""Template extraction on hand-annotated questions (annotations are given,
not computed), plus the default lexicon annotator and the island rule."""

import re

import pytest
from pyspark.sql import functions as F

from qtemplates.functions.prefix import prefix_end
from qtemplates.operators import annotate as A
from qtemplates.operators import chunk as CH
from qtemplates.sources.io import DEFAULT_PREFIXES

TOK = re.compile(r"[\w]+|[^\w\s]")


def _tokens(text, pos, aux=None):
    aux = aux or {}
    out = []
    for i, m in enumerate(TOK.finditer(text)):
        h = aux.get(i)
        out.append({"i": i, "idx": m.start(), "text": m.group(), "pos": pos[i],
                    "dep": "aux" if h is not None else "", "head": h if h is not None else i})
    return out


Q = {
    "q1": ("How does pruning improve parsing accuracy on small corpora?",
           "SCONJ AUX NOUN VERB NOUN NOUN ADP ADJ NOUN PUNCT", {1: 3}, [(2, 3), (4, 6), (7, 9)]),
    "q2": ("What software is used to effectively predict traffic?",
           "DET NOUN AUX VERB PART ADV VERB NOUN PUNCT", {4: 6}, [(0, 2), (7, 8)]),
    "q3": ("Is the parser accurate?", "AUX DET NOUN ADJ PUNCT", {}, [(1, 3)]),
    "q4": ("What models trained on rules predict speech?",
           "DET NOUN VERB ADP NOUN VERB NOUN PUNCT", {}, [(0, 2), (4, 5), (6, 7)]),
    "q5": ("What is the impact of the thing model on some parsers?",
           "PRON AUX DET NOUN ADP DET NOUN NOUN ADP DET NOUN PUNCT", {}, [(0, 1), (2, 4), (5, 8), (9, 11)]),
    "q6": ("How deep go neural networks?", "SCONJ ADJ VERB ADJ NOUN PUNCT", {}, [(3, 5)]),
    "q7": ("What models are used?", "DET NOUN AUX VERB PUNCT", {2: 3}, [(0, 2)]),
    "q8": ("Is the thing model good for speed?", "AUX DET NOUN NOUN ADJ ADP NOUN PUNCT", {}, [(1, 4), (6, 7)]),
}


def _collapse(orig, text):
    """Second-pass annotation: the first one with entity markers as PROPN."""
    toks = [m for m in TOK.finditer(text)]
    out, old_to_new, j = [], {}, 0
    for n, m in enumerate(toks):
        w = m.group()
        if re.fullmatch(r"EC\d+", w):
            rest = [t.group() for t in toks[n + 1:] if not re.fullmatch(r"EC\d+", t.group())]
            nxt = rest[0] if rest else None
            while j < len(orig) and orig[j]["text"] != nxt:
                j += 1
            out.append({"i": n, "idx": m.start(), "text": w, "pos": "PROPN", "dep": "", "head": n})
            continue
        while j < len(orig) and orig[j]["text"] != w:
            j += 1
        o = orig[j]
        old_to_new[j] = n
        out.append({"i": n, "idx": m.start(), "text": w, "pos": o["pos"], "dep": o["dep"], "head": o["head"]})
        j += 1
    for t in out:
        t["head"] = old_to_new.get(t["head"], t["i"]) if t["dep"] == "aux" else t["i"]
    return out


def _annotator(table):
    def run(df, text_col, tok_col, ch_col):
        def make():
            def fn(text):
                return table.get(text, ([], []))
            return fn
        return A.annotate_with(df, text_col, make, tok_col, ch_col)
    return run


def _build(spark, key, ec_text=None):
    text, pos, aux, chunks = Q[key]
    toks = _tokens(text, pos.split(), aux)
    table = {text: (toks, [{"start": s, "end": e} for s, e in chunks])}
    if ec_text is not None:
        table[ec_text] = (_collapse(toks, ec_text), [])
    return table


CASES = [
    ("q1", None, "How does EC1 improve EC2 on EC3?",
     {"EC1": "pruning", "EC2": "parsing accuracy", "EC3": "small corpora"}, "How does EC1 PC1 EC2 on EC3?"),
    ("q2", None, "What EC1 is used PC1 effectively PC1 EC2?",
     {"EC1": "software", "EC2": "traffic", "PC1": "predict"}, "What EC1 is PC1 PC2 effectively PC2 EC2?"),
    ("q3", None, "Is EC1 EC2?", {"EC1": "the parser", "EC2": "accurate"}, "Is EC1 EC2?"),
    ("q4", None, "What EC1 PC1 EC2 PC2 EC3?",
     {"EC1": "models", "EC2": "rules", "EC3": "speech", "PC1": "trained on", "PC2": "predict"}, None),
    ("q5", ["what is the impact of"], "What is the impact of EC1 EC2 on some EC3?",
     {"EC1": "the", "EC2": "thing", "EC3": "parsers"}, None),
    ("q5", [], "What is EC1 of EC2 EC3 on some EC4?",
     {"EC1": "the impact", "EC2": "the", "EC3": "thing", "EC4": "parsers"}, None),
    ("q6", None, "How EC1 PC1 EC2?", {"EC1": "deep", "EC2": "neural networks", "PC1": "go"}, None),
    # sentence-final verb after a copula becomes an entity
    ("q7", None, "What EC1 are EC2?", {"EC1": "models", "EC2": "used"}, None),
    # "the thing" takes two numbers; the next entity continues after them
    ("q8", None, "Is EC1 EC2 good for EC3?", {"EC1": "the", "EC2": "thing", "EC3": "speed"}, None),
]


@pytest.mark.parametrize("key,extra,want,want_map,want_fast", CASES)
def test_hand_annotated(spark, key, extra, want, want_map, want_fast):
    prefixes = (extra or []) + DEFAULT_PREFIXES if extra is not None else DEFAULT_PREFIXES
    text = Q[key][0]
    # the entity pass text is the expected template with PC markers undone
    ec_text = CH_ec_text(spark, key, prefixes)
    table = _build(spark, key, ec_text)
    df = spark.createDataFrame([(text,)], "research_question string")
    r = CH.extract_template_with_mapping(df, prefixes=prefixes, annotator=_annotator(table)).first()
    assert r.templated_question == want
    assert dict(r.mapping) == want_map
    if want_fast:
        f = CH.extract_template(df, prefixes=prefixes, annotator=_annotator(table)).first()
        assert f.templated_question == want_fast


def CH_ec_text(spark, key, prefixes):
    """Run the entity pass alone on the hand annotation."""
    text, pos, aux, chunks = Q[key]
    table = _build(spark, key)
    df = spark.createDataFrame([(text,)], "q string")
    df = _annotator(table)(df, "q", "t", "c")
    sp = CH.ec_spans(F.col("q"), F.col("t"), F.col("c"), prefix_end(F.col("q"), prefixes), "mapping")
    return df.select(CH.splice(F.col("q"), sp, "EC", True)["text"]).first()[0]


def test_lexicon_annotator_offsets(spark):
    qs = ["How  does éclair-type   pruning improve it?", "", "a"]
    df = A.annotate(spark.createDataFrame([(q,) for q in qs], "q string"), "q")
    for r in df.collect():
        for t in r.tokens:
            assert r.q[t.idx:t.idx + len(t.text)] == t.text


def test_default_pipeline_runs(spark):
    qs = ["What models trained on rules predict speech?", "How deep go neural networks?",
          "What software is used to effectively predict traffic?", "", "?"]
    df = spark.createDataFrame([(q,) for q in qs], "research_question string")
    out = {r.research_question: r for r in CH.wide_templates(CH.templates_from_questions(df)).collect()}
    assert out["What models trained on rules predict speech?"].templated_question == "What EC1 PC1 EC2 PC2 EC3?"
    assert out["How deep go neural networks?"].PC1 == "go"
    assert out["What software is used to effectively predict traffic?"].templated_question == \
        "What EC1 is used PC1 effectively PC1 EC2?"


# Tag sequences (V verb, P particle, J adjective, R adverb, I adposition, N
# noun) and their predicate spans, worked out by hand from the rule: a run of
# verbs and particles takes a following adposition, also across adjectives and
# adverbs; else it ends with its last verb, and without a verb it is dropped.
ISLANDS = [
    ("", []), ("N", []), ("V", [(0, 0)]), ("P", []), ("PV", [(0, 1)]), ("VP", [(0, 0)]), ("VPV", [(0, 2)]),
    ("VI", [(0, 1)]), ("PI", [(0, 1)]), ("VII", [(0, 1)]), ("VJI", [(0, 2)]), ("PRI", [(0, 2)]), ("VRJI", [(0, 3)]),
    ("VJN", [(0, 0)]), ("PRN", []), ("VPJN", [(0, 0)]), ("VJ", [(0, 0)]), ("VJV", [(0, 0), (2, 2)]), ("IV", [(1, 1)]),
    ("NVVINPV", [(1, 3), (5, 6)]), ("PPVPI", [(0, 4)]), ("JIV", [(2, 2)]), ("VNVI", [(0, 0), (2, 3)]), ("RVRRRIPN", [(1, 5)]),
]


def test_islands_by_hand(spark):
    tag = {"V": "VERB", "P": "PART", "J": "ADJ", "R": "ADV", "I": "ADP", "N": "NOUN"}
    rows = [(k, [{"i": i, "idx": i, "text": "w", "pos": tag[c], "dep": "", "head": i} for i, c in enumerate(s)])
            for k, (s, _) in enumerate(ISLANDS)]
    df = spark.createDataFrame(rows, f"k int, tokens {A.TOKEN_TYPE}")
    for r in df.select("k", CH.pc_islands(F.col("tokens")).alias("p")).collect():
        assert sorted((x.s, x.e) for x in r.p) == ISLANDS[r.k][1], ISLANDS[r.k][0]


def test_prefix_end_fast_path_equals_full(spark):
    pre = ["what is the impact of", "how"] + DEFAULT_PREFIXES
    qs = ["How", "how", "howdy x", "How do x", "What is the impact of", "what is the impact of x",
          "what is the impact ofx", "Why" + " z" * 200, "What is the impact of" + " y" * 300, "", "x"]
    df = spark.createDataFrame([(q,) for q in qs], "q string")
    rows = df.select(prefix_end(F.col("q"), pre).alias("a"), prefix_end(F.col("q"), pre, stripped=True).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
    assert [r.a for r in rows][:7] == [3, 3, None, 3, 21, 21, 4]


@pytest.mark.parametrize("key,extra,want,want_map,want_fast", CASES)
def test_collapsed_second_pass(spark, key, extra, want, want_map, want_fast):
    """reannotate=False derives the predicate-pass annotation from the first
    one; on the hand annotations it must give the same templates."""
    prefixes = (extra or []) + DEFAULT_PREFIXES if extra is not None else DEFAULT_PREFIXES
    table = _build(spark, key)            # first-pass annotation only
    df = spark.createDataFrame([(Q[key][0],)], "research_question string")
    r = CH.extract_template_with_mapping(df, prefixes=prefixes, annotator=_annotator(table), reannotate=False).first()
    assert r.templated_question == want
    assert dict(r.mapping) == want_map
    if want_fast:
        f = CH.extract_template(df, prefixes=prefixes, annotator=_annotator(table), reannotate=False).first()
        assert f.templated_question == want_fast


def test_collapse_offsets_and_heads(spark):
    df = spark.createDataFrame([("What software is used to effectively predict traffic?",)], "q string")
    df = A.annotate(df, "q")
    from qtemplates.functions.prefix import prefix_end as pe
    sp = CH.ec_spans(F.col("q"), F.col("tokens"), F.col("noun_chunks"), pe(F.col("q"), DEFAULT_PREFIXES))
    x = df.select("q", CH.splice(F.col("q"), sp, "EC", True).alias("ec"), "tokens")
    r = x.select(F.col("ec.text").alias("t"), CH.collapse_spans(F.col("tokens"), F.col("ec.kept")).alias("c")).first()
    for tok in r.c:
        assert r.t[tok.idx:tok.idx + len(tok.text)] == tok.text
        if tok.dep == "aux":
            assert r.c[tok.head].pos == "VERB"


def _plain_tags(words):
    """The lexicon rules token by token."""
    lists = [(A.DET, "DET"), (A.ADP, "ADP"), (A.PART, "PART"), (A.AUX, "AUX"), (A.PRON, "PRON"), (A.CCONJ, "CCONJ"), (A.SCONJ, "SCONJ")]
    first = []
    for t in words:
        w = t.lower()
        own = next((tag for words_, tag in lists if w in words_), None)
        if not any(c.isalnum() for c in t):
            tag = "PUNCT"
        elif re.fullmatch("(EC|PC)[0-9]+", t):
            tag = "PROPN"
        elif re.fullmatch("[0-9]+", t):
            tag = "NUM"
        elif own:
            tag = own
        elif w.endswith("ly"):
            tag = "ADV"
        elif w.endswith(("al", "ive", "ous", "able", "ible", "ful", "ic")):
            tag = "ADJ"
        elif w in A.VERB_WORDS or w.endswith(("ing", "ed", "ize", "ise")):
            tag = "VERB"
        else:
            tag = "NOUN"
        first.append(tag)
    return ["NOUN" if x == "VERB" and t.lower() in A.VERB_WORDS and i and first[i - 1] in ("DET", "ADJ") else x
            for i, (t, x) in enumerate(zip(words, first, strict=True))]


def test_tags_in_one_string(spark):
    qs = ["The use of EC1 EC2, EC EC12a Pc3 PC4", "x v V W A ly al ing The final use used 12 1a __ _", "to not improve; éclair Ally ISE ic", "", "?!", "EC1",
          "N O EC9 J", "the compare EC3 compare", "\u0130stanbul \u03a3\u03a3 \U0001d400 use \U0001f600"]
    rows = spark.createDataFrame([(q,) for q in qs], "q string").select("q", A.parsed(F.col("q")).alias("p")).collect()
    for r in rows:
        words = [t.text for t in r.p.tokens]
        assert words == TOK.findall(r.q)
        assert [t.pos for t in r.p.tokens] == _plain_tags(words)
        assert r.p.tags == "".join(A.LETTERS[t.pos] for t in r.p.tokens)


def test_very_long_line(spark):
    """A line of 700,000 characters: the same template as its parts."""
    part = "How does the parser improve accuracy of small models and predict speech quickly"
    n = 9000
    df = spark.createDataFrame([(part,), (" ".join([part] * n),)], "research_question string")
    for again in (True, False):
        short, long = (r.templated_question for r in CH.extract_template_with_mapping(df, prefixes=[], reannotate=again).collect())
        each = len(re.findall("EC[0-9]+", short))
        assert re.sub("[0-9]+", "", long) == " ".join([re.sub("[0-9]+", "", short)] * n)
        assert [int(x) for x in re.findall("EC([0-9]+)", long)] == list(range(1, n * each + 1))
