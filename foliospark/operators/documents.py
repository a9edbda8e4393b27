"""Raw report pages: plain text for scoring, lines for parsing, the score of a page, and the best page of each report."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from foliospark.functions import patterns as P
from foliospark.functions.text import collapse_ws, trim_ws


def strip_markup(html: Column) -> Column:
    """Scripts, styles and tags as spaces, white space collapsed and trimmed; entities stay."""
    s = F.regexp_replace(html, r"(?is)<script.*?>.*?</script>", " ")
    s = F.regexp_replace(s, r"(?is)<style.*?>.*?</style>", " ")
    return trim_ws(collapse_ws(F.regexp_replace(s, r"(?is)<[^>]+>", " ")))


@F.pandas_udf(StringType())
def unescape_entities(texts: pd.Series) -> pd.Series:
    """HTML entities as their characters; null stays null."""
    return texts.map(unescape, na_action="ignore")


def plain_text(html: Column) -> Column:
    """The text that a page is scored by: without markup, entities resolved, white space collapsed."""
    return trim_ws(collapse_ws(unescape_entities(strip_markup(html))))


def tidy_lines(text: Column) -> Column:
    """CR as LF, runs of space, tab, form feed and vertical tab as one space, no blanks at line starts, at most one blank line."""
    s = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("\n")), r"[ \t\f\x0B]+", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"\n[ \t\f\x0B]+", "\n"), r"\n{3,}", "\n\n")
    return trim_ws(s)


def markup_lines(html: Column) -> Column:
    """The lines of a page, all inside the JVM: each tag a line feed; scripts, styles and noscript parts dropped; entities stay."""
    s = html
    for part in ("script", "style", "noscript"):
        s = F.regexp_replace(s, rf"(?is)<{part}[^>]*>.*?</{part}>", "")
    return tidy_lines(F.regexp_replace(s, r"(?s)<[^>]*>", "\n"))


class _Nodes(HTMLParser):
    """The text nodes of a page, in order; br as a line feed, nothing of scripts, styles and noscript parts."""

    hidden = frozenset({"script", "style", "noscript"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs) -> None:
        if tag in self.hidden:
            self.depth += 1
        elif tag == "br":
            self.parts.append("\n")

    def handle_startendtag(self, tag, attrs) -> None:
        if tag == "br":
            self.parts.append("\n")

    def handle_endtag(self, tag) -> None:
        if tag in self.hidden and self.depth:
            self.depth -= 1

    def handle_data(self, data) -> None:
        if not self.depth and data:
            self.parts.append(data)


def _html_nodes(page: str) -> str:
    parser = _Nodes()
    parser.feed(page)
    parser.close()
    return "\n".join(parser.parts)


def _xml_nodes(page: str) -> str:
    """The text nodes of an XML page, CDATA included; the HTML parser's where the page is not well-formed."""
    from xml.parsers import expat

    nodes, reader = _Nodes(), expat.ParserCreate()
    reader.buffer_text = True
    reader.StartElementHandler = nodes.handle_starttag
    reader.EndElementHandler = nodes.handle_endtag
    reader.CharacterDataHandler = nodes.handle_data
    try:
        reader.Parse(re.sub(r"^\s*<\?xml.*?\?>", "", page, count=1, flags=re.DOTALL), True)  # the page is text already, whatever encoding it names
    except expat.ExpatError:
        return _html_nodes(page)
    return "\n".join(nodes.parts)


def _guarded(page: str, xml: bool) -> tuple[str | None, str | None]:
    """(text, None), or (None, what went wrong): a page that cannot be parsed stops no job."""
    try:
        return (_xml_nodes if xml else _html_nodes)(page), None
    except Exception as e:  # whatever a parser raises is about this page alone
        return None, f"{type(e).__name__}: {e}"


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("error", StringType())]))
def _parsed(pages: pd.Series, xml: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if page is None else _guarded(page, bool(x)) for page, x in zip(pages, xml)]
    return pd.DataFrame(rows, columns=["text", "error"], dtype="object")


def parse_page(page: Column) -> Column:
    """struct<text, error>: the text of a page by the parser that suits it (see looks_like_xml), before it is tidied.

    A null page has neither text nor error; a page whose parser fails has an error and no text.
    """
    return _parsed(page, F.coalesce(looks_like_xml(page), F.lit(False)))


def document_lines(page: Column) -> Column:
    """The lines of a page by a real parser: its text nodes joined by line feeds, entities resolved, then tidied."""
    return tidy_lines(parse_page(page)["text"])


def looks_like_xml(text: Column) -> Column:
    """An XML prolog after white space, an xbrl tag or prefix, or a document tag whose type is XML, wherever it stands."""
    return text.rlike(P.XML_PROLOG) | text.rlike(P.XBRL_TAG) | text.rlike(P.XML_DOCUMENT)


def decode_page(content: Column) -> Column:
    """Bytes as UTF-8 without the bytes that are none; a U+FFFD of the page itself stays.

    It stands as two noncharacters, which no text has, while the invalid bytes are taken out.
    """
    held = F.replace(content.cast("string"), F.lit("\ufffd"), F.lit("\ufdd0\ufdd1"))
    return F.replace(F.replace(F.make_valid_utf8(held), F.lit("\ufffd"), F.lit("")), F.lit("\ufdd0\ufdd1"), F.lit("\ufffd"))


def page_score(text: Column, size: Column, name: Column, *, short: int = 10_000, good_terms=P.GOOD_TERMS, headers=P.TARGET_HEADERS, bad_names=P.BAD_NAME_HINTS) -> Column:
    """How much a page looks like the report itself; the worst possible score for an unreadable one (null text)."""
    hits = sum((F.regexp_count(text, F.lit(h)) for h in headers), F.lit(0))
    score = F.least(F.floor(size / 1024), F.lit(5000)) + F.least(F.floor(F.length(text) / 1000), F.lit(20000))
    for term in good_terms:
        score = score + F.when(text.rlike(term), 10000).otherwise(0)
    score = score + hits * 1500
    for hint in bad_names:
        score = score - F.when(F.lower(name).contains(hint), 3000).otherwise(0)
    score = score - F.when(F.length(text) < short, 5000).otherwise(0) - F.when(hits == 0, 3000).otherwise(0)
    return F.when(text.isNull(), F.lit(-1_000_000_000)).otherwise(score).cast("bigint")


def best_page(pages: DataFrame, keys: list[str], *, score_col: str = "score", tie_col: str = "path") -> DataFrame:
    """One page for each of keys: the best score, of equal ones the least tie_col. All columns of pages are aggregated.

    Where pages hold texts, choose among their keys, scores and paths alone and read the winners afterwards.
    """
    rest = [c for c in pages.columns if c not in (*keys, score_col, tie_col)]
    row = F.struct((-F.col(score_col)).alias("a"), F.col(tie_col).alias("t"), *[F.col(c) for c in rest])
    best = pages.groupBy(*keys).agg(F.min(row).alias("r"))
    return best.select(*keys, (-F.col("r.a")).alias(score_col), F.col("r.t").alias(tie_col), *[F.col("r")[c].alias(c) for c in rest]).select(*pages.columns)
