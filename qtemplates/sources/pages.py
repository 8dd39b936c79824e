"""Extraction from raw HTML pages held in a ``pages(url, html)`` table.

Flat patterns (links, ``title``, ``h1``) are regex Columns.  Nested markup
(text of all descendants of a block, first child of a kind) needs a real
parser: stdlib ``html.parser`` inside ``mapInPandas``, one pass per page,
Arrow batches, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qtemplates.operators.ids import assign_ids

#: Comments, and scripts and styles with their bodies: no markup, no text.
NOT_TEXT = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
#: Attributes of an ``a`` tag; quoted values may hold anything.
A_TAG = r"""(?is)<a(?=[\s/])((?:[^>"']|"[^"]*"|'[^']*')*)>"""
#: The first ``href`` outside quotes: double-quoted, single-quoted or bare.
HREF = r"""(?is)^(?:[^"']|"[^"]*"|'[^']*')*?(?<=[\s/"'])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def without_hidden(html) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(F.col(html) if isinstance(html, str) else html, NOT_TEXT, "")


def _unescaped(values: pd.Series) -> pd.Series:
    from html import unescape
    return values.map(lambda v: v if v is None or "&" not in v else unescape(v))


def unescape(c: Column) -> Column:
    """Decode all character references, named and numeric (Arrow batches)."""
    return F.pandas_udf(_unescaped, "string")(c)


def extract_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """H1: every ``<a href>`` value, with its position on the page: any case of
    the names, any quoting, references decoded; none from comments."""
    def href(attributes):
        # one match: the three quotings are groups, of which one is not empty;
        # attributes begin with white space or a slash, never with the mark
        said = F.regexp_replace(attributes, HREF + ".*", "\x01$1$2$3")
        return F.when(said.startswith("\x01"), F.substring(said, 2, 1 << 30))
    found = F.filter(F.transform(F.regexp_extract_all(without_hidden(html_col), F.lit(A_TAG), F.lit(1)), href), lambda h: h.isNotNull())
    links = pages.select(F.col(url_col).alias("url"), F.posexplode(found).alias("pos", "href"))
    return links.withColumn("href", unescape(F.col("href")))


def filter_links(df: DataFrame, prefix: str, suffix: str, col: str = "href") -> DataFrame:
    """H2: keep hrefs that start with ``prefix`` and end with ``suffix``."""
    return df.filter(F.col(col).startswith(prefix) & F.col(col).endswith(suffix))


def absolutize(df: DataFrame, base, col: str = "href", out: str = "link") -> DataFrame:
    """H3: absolute URL by concatenation with a site base (string or Column)."""
    b = F.lit(base) if isinstance(base, str) else base
    return df.withColumn(out, F.concat(b, F.col(col)))


def site_base(url_col: str = "url") -> Column:
    """scheme://host of a page URL (a per-page base for H3)."""
    return F.regexp_extract(F.col(url_col), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)


def distinct_links(df: DataFrame, col: str = "link") -> DataFrame:
    """H4: the distinct link set, sorted."""
    return df.select(col).distinct().orderBy(col)


def _inner(html_col: str, tag: str) -> Column:
    """Inner HTML of every flat element, inner tags removed."""
    pat = rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"
    return F.transform(F.regexp_extract_all(without_hidden(html_col), F.lit(pat), F.lit(1)), lambda x: F.regexp_replace(x, r"<[^>]*>", ""))


def _stripped(c: str) -> Column:
    return F.regexp_replace(unescape(F.col(c)), r"(?U)^\s+|\s+\z", "")


def flat_elements(pages: DataFrame, tag: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """H5 for flat tags (``title``, ``h1``): (url, pos, text) with inner tags
    removed, references decoded, text stripped."""
    x = pages.select(F.col(url_col).alias("url"), F.posexplode(_inner(html_col, tag)).alias("pos", "inner"))
    return x.withColumn("text", _stripped("inner")).select("url", "pos", "text")


def zip_elements(pages: DataFrame, tag_a: str, tag_b: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """H7: (url, pos, text_a, text_b), the i-th flat element of one kind with
    the i-th of another; the shorter list wins.  Paired inside the page's own
    row: no join, and pages that share a URL stay apart."""
    both = F.arrays_zip(_inner(html_col, tag_a).alias("a"), _inner(html_col, tag_b).alias("b"))
    x = pages.select(F.col(url_col).alias("url"), F.posexplode(both).alias("pos", "z")).select("url", "pos", F.col("z.a"), F.col("z.b"))
    # the longer list's rest has nulls on the other side
    full = x.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    return full.select("url", "pos", _stripped("a").alias("text_a"), _stripped("b").alias("text_b"))


# ---------------------------------------------------------------- nested markup

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Collector(HTMLParser):
    """Collects elements with a given tag and class: their descendant text
    (no scripts, no styles), the text of their first ``inner`` element
    (``strong``) and the first ``a href`` inside that.
    A multi-word ``class_`` must equal the whole attribute; a single word
    may be any one of the classes."""

    def __init__(self, tag: str, class_: str | None, inner: str = "strong"):
        super().__init__(convert_charrefs=True)
        self.tag, self.class_, self.inner = tag, class_, inner
        self.stack: list[dict] = []
        self.open: list[dict] = []
        self.done: list[dict] = []
        self.n = 0

    def _match(self, tag, a) -> bool:
        if tag != self.tag:
            return False
        if self.class_ is None:
            return True
        c = a.get("class") or ""
        return c == self.class_ or self.class_ in c.split()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        frame = {"tag": tag, "el": None, "strong_of": []}
        for el in self.open:
            if tag == self.inner and el["strong"] is None:
                el["strong"], el["in_strong"] = [], True
                frame["strong_of"].append(el)
            elif tag == "a" and el["in_strong"] and el["href"] is None and "href" in a:
                el["href"] = a["href"]
        if self._match(tag, a):
            el = {"order": self.n, "text": [], "strong": None, "href": None, "in_strong": False}
            self.n += 1
            self.open.append(el)
            frame["el"] = el
        if tag in _VOID:
            self._end(frame)
        else:
            self.stack.append(frame)

    def _end(self, frame):
        for el in frame["strong_of"]:
            el["in_strong"] = False
        if frame["el"] is not None:
            self.open.remove(frame["el"])
            self.done.append(frame["el"])

    def handle_endtag(self, tag):
        if not any(f["tag"] == tag for f in self.stack):
            return
        while self.stack:
            f = self.stack.pop()
            self._end(f)
            if f["tag"] == tag:
                break

    def handle_data(self, data):
        if self.stack and self.stack[-1]["tag"] in ("script", "style"):
            return
        for el in self.open:
            el["text"].append(data)
            if el["in_strong"]:
                el["strong"].append(data)

    def finish(self) -> list[dict]:
        self.close()
        while self.stack:
            self._end(self.stack.pop())
        return sorted(self.done, key=lambda e: e["order"])


def _parse(page: str, tag: str, class_: str | None, inner: str = "strong") -> list[dict]:
    p = _Collector(tag, class_, inner)
    p.feed(page or "")
    return p.finish()


ELEMENT_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("pos", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("href", T.StringType()), T.StructField("error", T.StringType())])


def extract_elements(pages: DataFrame, tag: str, class_: str | None = None,
                     url_col: str = "url", html_col: str = "html", skip_failed: bool = True) -> DataFrame:
    """H5 + H6 + H10: elements by tag and exact class string.  ``text`` =
    all descendant text, stripped; ``title`` = text of the first ``strong``
    inside; ``href`` = first ``a href`` inside that ``strong``.  A page that
    fails to parse yields one row with ``error`` set (dropped when
    ``skip_failed``)."""
    src = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterable):
        import pandas as pd
        for pdf in batches:
            rows = []
            for url, page in zip(pdf["url"], pdf["html"]):
                try:  # whole-page skip: rows of a failed page are not kept
                    rows.extend((url, i, "".join(el["text"]).strip(),
                                 None if el["strong"] is None else "".join(el["strong"]).strip(),
                                 el["href"], None) for i, el in enumerate(_parse(page, tag, class_)))
                except Exception as e:  # noqa: BLE001
                    rows.append((url, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[f.name for f in ELEMENT_SCHEMA.fields])

    out = src.mapInPandas(run, ELEMENT_SCHEMA)
    return out.filter(F.col("error").isNull()) if skip_failed else out


_ZIPPED = "url string, pos int, title string, abstract string, href string, error string"


def abstracts_from_pages(pages: DataFrame, block_tag: str, block_class: str | None,
                         title_tag: str, title_class: str | None, base, inner: str = "strong",
                         order_by=("url", "pos", "abstract"), skip_failed: bool = True) -> DataFrame:
    """(id, title, abstract, url) from volume pages: abstract blocks zipped
    with title blocks by position, defaults "No Title" / "No URL" (H8),
    consecutive ids in page order (H9).  A title is the text of the first
    ``inner`` element of its block, the link the first one inside that.  Both
    lists come from one row and are zipped there."""
    src = pages.select("url", "html")

    def run(batches: Iterable):
        import pandas as pd_
        for pdf in batches:
            rows = []
            for url, page in zip(pdf["url"], pdf["html"]):
                try:
                    blocks, titles = _parse(page, block_tag, block_class), _parse(page, title_tag, title_class, inner)
                    rows.extend((url, i, None if t["strong"] is None else "".join(t["strong"]).strip(), "".join(b["text"]).strip(), t["href"], None)
                                for i, (b, t) in enumerate(zip(blocks, titles)))
                except Exception as e:  # noqa: BLE001
                    rows.append((url, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd_.DataFrame(rows, columns=["url", "pos", "title", "abstract", "href", "error"])

    z = src.mapInPandas(run, _ZIPPED)
    if skip_failed:
        z = z.filter(F.col("error").isNull())
    at = F.lit(base) if isinstance(base, str) else base
    z = z.select("url", "pos", F.coalesce("title", F.lit("No Title")).alias("title"), "abstract",
                 F.when(F.col("href").isNotNull(), F.concat(at, F.col("href"))).otherwise(F.lit("No URL")).alias("link"))
    ids = assign_ids(z, [F.col(c) for c in order_by], 1, "id")
    return ids.select("id", "title", "abstract", F.col("link").alias("url"))


__all__ = ["extract_links", "filter_links", "absolutize", "site_base", "distinct_links", "flat_elements",
           "zip_elements", "extract_elements", "abstracts_from_pages", "unescape", "without_hidden"]
