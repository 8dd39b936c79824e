"""Template extraction by word lists in one pass over a text.

The rules of ``annotate`` and ``chunk`` (A1, C1-C10, P1-P6) for the annotators
that are a word list: the default tagger and small lexicon tables.  Those need
nothing but the text, so a text goes to a Python worker as it is and comes back
as template and marker map; tokens, tags and spans are plain lists there,
where Columns would build a struct for each and interpret a lambda for each
element.  Tokens, tags and their offsets come out of the regex engine and
``accumulate``; loops run over chunks, islands and spans only.

``chunk.ec_spans``, ``pc_spans``, ``splice`` and ``collapse_spans`` hold the
same rules as Columns for tokens that any other annotator gives.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from qtemplates.functions.prefix import STARTER_PAIRS, STARTER_WORDS, prefix_regex
from qtemplates.operators import annotate as A

#: Words whose letters a worker remembers; a fuller table starts anew.
_REMEMBERED = 1 << 17

# tokens, with the ASCII separators that Java takes for punctuation and Python for white space
_TOKEN = re.compile(r"(\w+|[^\w\s]|[\x1c-\x1f])")
_DIGITS = re.compile(r"[0-9]+")
_MARKER = re.compile(r"(?:EC|PC)[0-9]+")
_NOUN_AFTER = re.compile(f"(?<=[DJ]){A._LISTED_VERB}")
_CHUNK = re.compile(A.CHUNK_TAGS)
_ISLAND = re.compile(A.ISLAND_TAGS)
_AUX = re.compile(f"[{A.LETTERS['AUX']}{A.LETTERS['PART']}](?=.{{0,2}}{A.LETTERS['VERB']})")
_SUFFIXES = [(tuple(A.ADV_ENDS), A.LETTERS["ADV"]), (tuple(A.ADJ_ENDS), A.LETTERS["ADJ"]), (tuple(A.VERB_ENDS), A.LETTERS["VERB"])]
_STARTERS = frozenset(STARTER_WORDS)
_STARTER_PAIRS = frozenset(STARTER_PAIRS)
_START = itemgetter(0)


class _Letters(dict):
    """The letter of a token alone, as ``annotate.letters_of``."""

    def __init__(self, listed: dict[str, str]):
        super().__init__()
        self.listed = listed

    def __missing__(self, t: str) -> str:
        if len(self) >= _REMEMBERED:
            self.clear()
        out = self[t] = self.letter(t, t.lower())
        return out

    def letter(self, t: str, w: str) -> str:
        if not "a" <= w[0] <= "z":
            if not (t.isalnum() or any(map(str.isalnum, t))):
                return A.LETTERS["PUNCT"]
            if _DIGITS.fullmatch(w):
                return A.LETTERS["NUM"]
        elif _MARKER.fullmatch(t):
            return A.LETTERS["PROPN"]
        own = self.listed.get(w)
        if own is not None:
            return own
        for ends, c in _SUFFIXES:
            if w.endswith(ends):
                return c
        return A.LETTERS["NOUN"]


class Extractor:
    """Text -> (template, marker names, marker texts); ``listed`` as for
    ``annotate.letters_of``, ``reject`` the texts that are no entity and no
    predicate chunk, ``again`` whether the entity-marked text is annotated
    again or gets the first annotation, collapsed."""

    def __init__(self, listed: dict[str, str], prefixes: Sequence[str], reject: tuple[Sequence[str], Sequence[str]], again: bool = True):
        from qtemplates.operators import chunk as CH
        self.letters = _Letters(listed)
        self.width = max((len(p) for p in prefixes), default=0) + 1
        self.prefix = re.compile(prefix_regex(prefixes).replace("(?= |\\z)", "(?= |\\Z)"))
        self.no_ec, self.no_pc = frozenset(reject[0]), frozenset(reject[1])
        self.again = again
        self.quantifiers, self.leading_aux, self.copula = (frozenset(x) for x in (CH.LEADING_QUANTIFIERS, CH.LEADING_AUX, CH.FINAL_COPULA))

    def __call__(self, q: str) -> tuple[str, list[str], list[str]]:
        pieces = _TOKEN.split(q)
        tags = self.tags(pieces)
        text, keys, values, kept = _spliced(q, self.entities(q, pieces, tags))
        if self.again:
            pieces = _TOKEN.split(text)
            tags = self.tags(pieces)
            aux: dict[int, list[int]] = {}
            for m in _AUX.finditer(tags):
                aux.setdefault(tags.index("V", m.start() + 1), []).append(m.start())
        else:
            pieces, tags, aux = _collapsed(pieces, tags, kept)
        text, more_keys, more_values, _ = _spliced(text, self.predicates(text, pieces, tags, aux))
        return text, keys + more_keys, values + more_values

    def tags(self, pieces: list[str]) -> str:
        """The tags as letters of a text in pieces: what lies between tokens,
        and tokens, in turn."""
        tags = "".join(map(self.letters.__getitem__, pieces[1::2]))
        if A._LISTED_VERB in tags:
            tags = _NOUN_AFTER.sub(A.LETTERS["NOUN"], tags).replace(A._LISTED_VERB, A.LETTERS["VERB"])
        return tags

    def prefix_end(self, text: str) -> int:
        """Q1, or 0."""
        m = self.prefix.match(text[:self.width].lower())
        return m.end() if m else 0

    @staticmethod
    def starters(words: list[str]) -> tuple[bool, bool]:
        """Q2: are the first and the second token part of a question starter?"""
        if not words:
            return False, False
        first = words[0].lower()
        pair = len(words) > 1 and (first, words[1].lower()) in _STARTER_PAIRS
        return pair or first in _STARTERS, pair

    def entities(self, text: str, pieces: list[str], tags: str) -> list[tuple]:
        """Spans (start, end, kind, text, no number, first token, end
        of tokens) in text order, before splicing."""
        words, starts, ends = _places(pieces)
        n, pe, reject = len(words), self.prefix_end(text), self.no_ec
        at0, at1 = self.starters(words)
        out = []
        if n > 2 and tags.startswith("JV", 1) and words[0].lower() == "how":                 # C7
            out.append((starts[1], ends[1], 1, words[1], None, 1, 2))
        for m in _CHUNK.finditer(tags):
            s, e = m.span()
            low = words[s].lower()
            i = s
            if low == "how" or (e - s > 1 and low.startswith("wh")):                         # C2
                i += 1
                low = words[i].lower() if i < e else ""
            if low in self.quantifiers:
                i += 1
            if i >= e:
                continue
            b, end = starts[i], ends[e - 1]
            if b < pe:                                                                       # C3
                continue
            v = text[b:end]
            clean = v.strip()
            if not clean or clean.lower() in reject:                                         # C4
                continue
            if i <= 1 and ((i == 0 and at0) or (e > 1 and at1)):                             # C5
                continue
            if e == 1 and s == 0 and tags[0] in "UV" and words[0].lower() in self.leading_aux:  # C6
                continue
            out.append((b, end, 2 if end - b > 9 and "the thing" in clean else 1, v, None, i, e))  # C8
        if n >= 2 and words[-1] == "?":                                                      # C9
            tag, i = tags[-2], n - 2
            if ((tag in "JR" or (tag == "V" and n >= 3 and words[-3] in self.copula))
                    and words[i].lower() not in reject and not (i == 0 and at0) and not (i == 1 and at1)):
                out.append((starts[i], ends[i], 1, words[i], None, i, i + 1))
        out.sort(key=_START)
        return out

    def predicates(self, text: str, pieces: list[str], tags: str, aux: dict[int, list[int]]) -> list[tuple]:
        """Numbered predicate spans and their auxiliaries (kind 0);
        ``aux`` has the auxiliaries of a token."""
        words, starts, ends = _places(pieces)
        pe, reject = self.prefix_end(text), self.no_pc
        at0, at1 = self.starters(words)
        out, behind, num = [], [], 0
        for m in _ISLAND.finditer(tags):
            s, e = m.span()
            b, end = starts[s], ends[e - 1]
            if b < pe:
                continue
            v = text[b:end]
            clean = v.strip()
            if not clean or clean.lower() in reject or (s <= 1 and ((s == 0 and at0) or (e > 1 and at1))):
                continue
            num += 1
            out.append((b, end, 1, v, num, s, e))
            if not aux:
                continue
            i = max((k for head in range(s, e) for k in aux.get(head, ()) if k < s or k >= e), default=-1)
            if i >= 0 and words[i].lower() not in reject and not (i == 0 and at0) and not (i == 1 and at1):
                behind.append((starts[i], ends[i], 0, None, num, i, i + 1))
        if behind:
            out += behind
            out.sort(key=_START)
        return out


def _places(pieces: list[str]) -> tuple[list[str], list[int], list[int]]:
    """Tokens, their offsets and the offsets behind them."""
    ends = list(accumulate(map(len, pieces)))
    return pieces[1::2], ends[0::2], ends[1::2]


def _spliced(text: str, spans: list[tuple]):
    """Text with markers, their names and texts, and the spans kept
    as (first token, end of tokens, markers); spans without a number are entities."""
    out, keys, values, kept = [], [], [], []
    at, count = 0, 1
    for b, e, kind, v, num, s, t in spans:
        if b < at:
            continue
        if num is not None:
            marks = [f"PC{num}"]
        elif kind == 2:
            marks = [f"EC{count}", f"EC{count + 1}"]
            v = None
            values += ("the", "thing")
        else:
            marks = [f"EC{count}"]
        if kind:
            keys += marks
        if v is not None:
            values.append(v)
        out.append(text[at:b])
        out.append(" ".join(marks))
        kept.append((s, t, marks))
        count += len(marks)
        at = e
    out.append(text[at:])
    return "".join(out), keys, values, kept


def _collapsed(pieces: list[str], tags: str, kept: list[tuple]):
    """The first annotation with the tokens of each kept span as its markers
    (``chunk.collapse_spans``): pieces, tags and auxiliaries by head."""
    out, letters, moved = [], [], [0]
    i = 0
    for s, t, marks in kept:
        out += pieces[2 * i:2 * s + 1]
        out += marks if len(marks) == 1 else (marks[0], " ", marks[1])
        letters += (tags[i:s], A.LETTERS["PROPN"] * len(marks))
        moved.append(moved[-1] + len(marks) - (t - s))
        i = t
    out += pieces[2 * i:]
    letters.append(tags[i:])
    firsts = [s for s, _, _ in kept]

    def place(k: int) -> tuple[int, bool]:
        """Where a token went, and whether as part of a marker."""
        j = bisect_right(firsts, k)
        if j and k < kept[j - 1][1]:
            return firsts[j - 1] + moved[j - 1], True
        return k + moved[j], False

    aux: dict[int, list[int]] = {}
    for m in _AUX.finditer(tags):
        k, marked = place(m.start())
        if not marked:
            aux.setdefault(place(tags.index("V", m.start() + 1))[0], []).append(k)
    return out, "".join(letters), aux


_EXTRACTORS: dict = {}


def extracted(text: Column, listed: dict[str, str], prefixes: Sequence[str], reject: tuple[Sequence[str], Sequence[str]], again: bool = True,
              mapping: bool = True) -> Column:
    """Struct of ``text``, the template, and, with ``mapping``, ``map`` (marker
    -> chunk text); null for a null text."""
    made = (tuple(sorted(listed.items())), tuple(prefixes), tuple(map(tuple, reject)), again)

    def run(texts):
        # built once per Python worker
        from qtemplates.operators import extract as mod   # the worker's module, not a pickled copy
        fn = mod._EXTRACTORS.get(made)
        if fn is None:
            fn = mod._EXTRACTORS[made] = mod.Extractor(dict(made[0]), *made[1:])
        return mod._batch(fn, texts, mapping)
    kind = "struct<text:string,map:map<string,string>>" if mapping else "struct<text:string>"
    # a text may hold bytes that are no UTF-8, which Arrow would hand on
    return F.arrow_udf(run, kind)(F.make_valid_utf8(text))


def _batch(fn, texts: pa.Array, mapping: bool) -> pa.Array:
    """``fn`` over an array of texts."""
    out, sizes, keys, values = [], [0], [], []
    for q in texts.to_pylist():
        if q is None:
            out.append(None)
        else:
            text, k, v = fn(q)
            out.append(text)
            if mapping:
                keys += k
                values += v
        sizes.append(len(keys))
    none = pa.array([t is None for t in out], pa.bool_())
    cols, names = [pa.array(out, pa.string())], ["text"]
    if mapping:
        offsets = pa.array([None if t is None else n for t, n in zip(out, sizes)] + sizes[-1:], pa.int32())
        cols.append(pa.MapArray.from_arrays(offsets, pa.array(keys, pa.string()), pa.array(values, pa.string())))
        names.append("map")
    return pa.StructArray.from_arrays(cols, names, mask=none)
