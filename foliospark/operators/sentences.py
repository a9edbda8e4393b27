"""Sentence splitting inside the JVM, merging of fragments, and weights of sentences full of placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import patterns as P
from foliospark.functions.text import trim_ws


_SPACE = r"[ \t\n\r\f\x0B]"
_BEFORE = r"""(^|[ \t\n\r\f\x0B("\[])"""


def split_sentences(text: Column) -> Column:
    """array<string>: cut after . ! or ? and white space, trimmed, without blank ones. An empty array for null.

    The full stop of a known abbreviation ends nothing: of a title or the like never, of a number's only before no figure, of
    a company's or a country's only before a word that opens sentences.
    """
    s = F.translate(text, "\x01\x02\x03", "   ")
    for _ in range(2):  # neighbours share the space between them
        s = F.regexp_replace(s, rf"{_BEFORE}({P.NEVER_ENDS})\.({_SPACE})", "$1$2\x02$3")
        s = F.regexp_replace(s, rf"{_BEFORE}({P.BEFORE_FIGURES})\.({_SPACE}+[0-9])", "$1$2\x02$3")
        s = F.regexp_replace(s, rf"{_BEFORE}({P.MAY_END})\.({_SPACE})", "$1$2\x03$3")
    s = F.regexp_replace(s, rf"\x03({_SPACE}+)({P.OPENERS})([^A-Za-z0-9_]|$)", ".$1$2$3")
    parts = F.split(F.regexp_replace(s, rf"([.!?]){_SPACE}+", "$1\x01"), "\x01", -1)
    return F.coalesce(F.filter(F.transform(parts, lambda x: trim_ws(F.translate(x, "\x02\x03", ".."))), lambda x: x != ""), F.array().cast("array<string>"))


def merge_fragments(sentences: Column, min_len: int = 25) -> Column:
    """Fragments under min_len wait and go before the next long sentence; what waits at the end comes last, by itself.

    Each long sentence takes the stretch from the long one before it; no sentence leaves the row or is copied twice.
    """

    def merged(s: Column) -> Column:
        long = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: F.length(F.get(s, i - 1)) >= min_len)

        def joined(ends: Column) -> Column:
            ends = F.when(F.element_at(F.concat(F.array(F.lit(0)), ends), -1) < F.size(s), F.concat(ends, F.array(F.size(s)))).otherwise(ends)
            at = lambda e, k: F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1))
            return F.transform(ends, lambda e, k: F.array_join(F.slice(s, at(e, k) + 1, e - at(e, k)), " "))

        return F.flatten(F.transform(F.array(long), joined))

    clean = F.filter(F.transform(sentences, trim_ws), lambda s: s != "")
    none = F.array().cast("array<string>")
    return F.when(F.size(clean) > 0, F.flatten(F.transform(F.array(clean), merged))).otherwise(F.when(sentences.isNotNull(), none))


def brand_weight(sentence: Column, threshold: float = 0.25) -> Column:
    """1 up to the threshold share of tokens with a placeholder, then falling to 0.2."""
    tokens = F.filter(F.split(sentence, r"(?U)\s+"), lambda t: t != "")
    share = F.size(F.filter(tokens, lambda t: t.contains(P.PLACEHOLDER))) / F.size(tokens)
    falling = F.greatest(F.lit(0.2), F.lit(1.0) - (share - threshold) * 1.2)
    return F.when(~sentence.contains(P.PLACEHOLDER) | (share <= threshold), F.lit(1.0)).otherwise(falling)
