"""License scans: phrases, and short notices found with bounded errors.

A text is reduced to its words (A-Z lower-cased, runs of ASCII letters and
digits and everything from U+0080 on), joined by single spaces.  The method
looks for short notices in it with up to ``k`` edits, ``k`` a share of the
notice's length: cut a notice into ``k + 1`` parts, and any place that matches
with ``k`` edits holds one part unchanged (pigeonhole).  All parts of all
notices are sought at once by an Aho-Corasick automaton; around each hit the
``regex`` library matches the notice with bounded errors, which verifies the
place and gives its span and number of edits.

Only a text's own words decide; it runs in Arrow batches, one text at a time,
linear in the text.

Cases: a null text counts as empty; texts without words have no places; equal
rows get equal results; overlapping places of one notice are reported once, the
one with fewest errors first found; an empty table gives an empty result; only
the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qtemplates.llm.common import text_or_empty

#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Short notices and their labels, as words.
NOTICES = (
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-notice", "the software is provided as is without warranty of any kind"),
    ("mit-notice", "released under the mit license"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("gpl-notice", "licensed under the gnu general public license"),
    ("gpl-notice", "under the terms of the gnu general public license"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification"),
    ("cc-notice", "licensed under a creative commons attribution"),
    ("copyright-notice", "all rights reserved"),
)
#: Edits allowed per character of a notice.
ERROR_SHARE = 0.12
#: Bytes that are not part of words become spaces; A-Z becomes a-z.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
           "notices array<struct<label:string,first_word:bigint,last_word:bigint,errors:int,score:double>>")


def parts(notice: str, share: float) -> tuple[int, list[tuple[int, str]]]:
    """Allowed edits k and the k + 1 (offset, part) of a notice."""
    k = max(1, int(len(notice) * share))
    cuts = [i * len(notice) // (k + 1) for i in range(k + 2)]
    return k, [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Scanner:
    def __init__(self, phrases, notices, share: float):
        import ahocorasick
        import regex
        self.phrases = [(re.compile(rb"(?:^| )" + p.encode() + rb"(?= |$)"), p.count(" "), label) for p, label in phrases]
        # a text without the phrases' longest common ending holds none of them
        self.anchor = os.path.commonprefix([p[::-1] for p, _ in phrases])[::-1].encode()
        self.seeds = ahocorasick.Automaton()
        held: dict[str, list] = {}
        self.notices = []
        for n, (label, notice) in enumerate(notices):
            k, own = parts(notice, share)
            self.notices.append((label, notice, k, regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={k}}}")))
            for offset, part in own:
                held.setdefault(part, []).append((n, offset))
        for part, where in held.items():
            self.seeds.add_word(part, (len(part), where))
        self.seeds.make_automaton()

    def places(self, words: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, errors) in characters of ``words``."""
        spans: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.seeds.iter(words):
            for n, offset in where:
                _, notice, k, _ = self.notices[n]
                start = end + 1 - size - offset
                lo, hi = max(0, start - k), min(len(words), start + len(notice) + k)
                own = spans.setdefault(n, [])
                if own and lo <= own[-1][1] and own[-1][1] - own[-1][0] < 8 * len(notice):
                    own[-1][0], own[-1][1] = min(lo, own[-1][0]), max(hi, own[-1][1])
                else:
                    own.append([lo, hi])
        found = []
        for n, own in spans.items():
            _, notice, k, pattern = self.notices[n]
            past = -1
            for i, (lo, hi) in enumerate(own):
                # what reaches into the next window is left to that one, which sees all of it
                edge = own[i + 1][0] if i + 1 < len(own) and own[i + 1][0] < hi else hi
                todo = [(max(lo, past), hi)]
                while todo:  # the best place, then the parts before and after it
                    a, b = todo.pop()
                    m = pattern.search(words, a, b) if a < b else None
                    if m is None or m.end() == m.start():
                        continue
                    todo += [(a, m.start()), (m.end(), b)]
                    if m.end() > edge:
                        own[i + 1][0] = min(own[i + 1][0], m.start())
                    else:
                        found.append((m.start(), m.end(), n, sum(m.fuzzy_counts)))
                        past = max(past, m.end())
        return sorted(found)

    def scan(self, text: str) -> tuple:
        data = b" ".join(text.encode().translate(_WORDS).split())
        words = np.frombuffer(data, np.uint8)
        gaps = np.flatnonzero(words == 32)
        base, labels = [], set()
        if self.anchor in data:
            for pattern, gaps_inside, label in self.phrases:
                for m in pattern.finditer(data):
                    base.append(int(np.searchsorted(gaps, m.end() - 1, "right")) - gaps_inside)
                    labels.add(label)
        notices = []
        joined = data.decode()
        spaces = gaps if joined.isascii() else None
        for start, end, n, errors in self.places(joined):
            if spaces is None:
                spaces = np.array([i for i, c in enumerate(joined) if c == " "])
            label, notice, _, _ = self.notices[n]
            notices.append({"label": label, "first_word": int(np.searchsorted(spaces, start, "left")), "last_word": int(np.searchsorted(spaces, end - 1, "left")),
                            "errors": errors, "score": 1 - errors / len(notice)})
        return len(gaps) + bool(data), len(base), min(base, default=None), max(base, default=None), sorted(labels), notices


_LOADED: dict = {}


def _scanner(phrases, notices, share) -> Scanner:
    if (phrases, notices, share) not in _LOADED:
        _LOADED[phrases, notices, share] = Scanner(phrases, notices, share)
    return _LOADED[phrases, notices, share]


def scan(documents: DataFrame, phrases=PHRASES, notices=NOTICES, share: float = ERROR_SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels and notices
    (label, first and last word, errors, score) of every row."""
    phrases, notices = tuple(phrases), tuple(notices)
    doc_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from qtemplates.llm import licenses as own
        scanner = own._scanner(phrases, notices, share)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()),
                 pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32()), ("score", pa.float64())])))
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "notices"]
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column("text")]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return documents.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {doc_type}, {_SCHEMA}")


def digest(documents: DataFrame) -> DataFrame:
    """``scan`` with labels joined: base_labels, labels (base and notices) and
    score (1 for a base phrase, else the best notice's, else 0)."""
    rows = scan(documents)
    both = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("notices", lambda n: n["label"]))))
    best = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("notices", lambda n: n["score"])), F.lit(0.0)))
    spans = F.array_join(F.transform("notices", lambda n: F.concat_ws(":", n["label"], n["first_word"].cast("string"), n["last_word"].cast("string"), n["errors"].cast("string"))), ",")
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                       F.array_join(both, ",").alias("labels"), best.alias("score"), spans.alias("notices"))
