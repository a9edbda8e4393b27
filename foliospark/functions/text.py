"""Column -> Column text helpers. They stay inside the JVM; patterns are spelled for Java with Unicode classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_ws(c: Column) -> Column:
    """Strip Unicode white space, no-break spaces included, at both ends (trim() knows U+0020 only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_ws(c: Column) -> Column:
    """Each run of Unicode white space becomes one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def norm_ticker(c: Column) -> Column:
    """Tickers compare trimmed and in upper case; null stays null and matches nothing."""
    return F.upper(trim_ws(c))


def is_blank(c: Column) -> Column:
    """True for null and for texts of white space only."""
    return F.coalesce(~c.rlike(r"(?U)\S"), F.lit(True))


def first_n(c: Column, n: int) -> Column:
    """The first n code points; the empty string for null and for n <= 0."""
    return F.coalesce(F.substring(c, 1, n), F.lit("")) if n > 0 else F.lit("")


def join_nonempty(parts: list[Column], sep: str) -> Column:
    """The parts that are neither null nor empty, with sep between them."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), sep)


def safe_name(c: Column) -> Column:
    """Every character outside letters, digits, dot, underscore and hyphen becomes an underscore."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def norm_label(c: Column) -> Column:
    """The section key of a free label: 1A, 1, 7A or 7 where it is named (in this order), else the cleaned label; null as 'none'."""
    s = F.regexp_replace(F.lower(trim_ws(F.coalesce(c, F.lit("none")))), r"(?U)[\s.\-:_]+", " ")
    out = s
    for key in ("7", "7A", "1", "1A"):
        low = key.lower()
        out = F.when(s.contains(f"item {low}") | s.isin(low, f"item{low}"), F.lit(key)).otherwise(out)
    return out


def norm_item(c: Column) -> Column:
    """Upper case without ITEM, trimmed, a final dot of the four section numbers removed."""
    s = trim_ws(F.replace(F.replace(F.upper(c), F.lit("ITEM "), F.lit("")), F.lit("ITEM"), F.lit("")))
    return F.when(s.isin("1A.", "7.", "1.", "7A."), F.regexp_replace(s, r"\.$", "")).otherwise(s)


def zero_fill(c: Column, width: int) -> Column:
    """Zeros on the left up to width; longer values stay whole (lpad would cut them)."""
    s = c.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def running_sums(numbers: Column) -> Column:
    """array<int>: the sum of all numbers up to each, itself included.

    By blocks of about the square root of their number, so that long arrays cost little more than short ones for each number.
    """

    def sums(a: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1))
        total = lambda x: F.aggregate(x, F.lit(0), lambda acc, v: acc + v)
        blocks = F.transform(F.sequence(F.lit(0), width - 1), lambda k: total(F.slice(a, k * width + 1, width)))
        before = lambda at: F.transform(F.sequence(F.lit(0), width - 1), lambda k: total(F.slice(at, F.lit(1), k)))

        def all_of(offsets: Column) -> Column:
            return F.transform(a, lambda _, i: F.get(offsets, F.floor(i / width).cast("int")) + total(F.slice(a, F.floor(i / width).cast("int") * width + 1, i % width + 1)))

        # Bound as variables: written out, they would be made again for each number.
        return F.flatten(F.transform(F.transform(F.array(blocks), before), all_of))

    return F.when(F.size(numbers) > 0, F.flatten(F.transform(F.array(numbers), sums))).otherwise(F.array().cast("array<int>"))


def parts_at(text: Column, pattern: str) -> Column:
    """array<string>: text cut before each match of pattern, whose first group must begin where the match does.

    A mark is put before each match and the text is split there. A U+0001 of the text itself is taken for a space first.
    """
    return F.split(F.regexp_replace(F.translate(text, "\x01", " "), pattern, "\x01$1"), "\x01", -1)


def match_starts(text: Column, pattern: str) -> Column:
    """0-based code point offsets of all matches; pattern's first group must begin where the match does.

    The lengths of the parts between matches are added up: offsets count code points, which regexp_instr does not.
    """
    lengths = F.transform(parts_at(text, pattern), F.length)
    return F.when(text.isNotNull(), running_sums(F.slice(lengths, 1, F.size(lengths) - 1)))


def heads(ascending: Column) -> Column:
    """Every k-th number, k about the square root of how many there are: an index for first_above."""

    def picked(a: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1))
        return F.filter(a, lambda _, i: i % width == 0)

    return F.flatten(F.transform(F.array(ascending), picked))


def first_above(ascending: Column, index: Column, bound: Column) -> Column:
    """The first of the ascending numbers that is over bound, or null; index are their heads, so only one block is read."""
    width = F.greatest(F.ceil(F.sqrt(F.size(ascending))).cast("int"), F.lit(1))
    block = F.size(F.filter(index, lambda h: h <= bound))
    near = F.slice(ascending, F.greatest(block - 1, F.lit(0)) * width + 1, width + 1)
    return F.array_min(F.filter(near, lambda x: x > bound))


def summarize(c: Column, n: int = 240) -> Column:
    """White space collapsed, cut to n code points, with an ellipsis only if something was cut."""
    s = collapse_ws(trim_ws(c))
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)
