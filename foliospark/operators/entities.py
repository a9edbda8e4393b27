"""Brand names: discovery of frequent capitalized phrases, and collapse of repeated mentions in a paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import patterns as P


def capitalized_grams(line: Column) -> Column:
    """All runs of one to three capitalized tokens of a line (over the tokens, not the words), without known non-brands.

    A token that is a known non-brand starts no phrase.
    """
    none = F.array(*[F.lit(x) for x in P.NO_BRANDS])

    def grams(tokens: Column) -> Column:
        def at(t: Column, i: Column) -> Column:
            two = F.when(i + 1 < F.size(tokens), F.concat_ws(" ", t, F.get(tokens, i + 1)))
            three = F.when(i + 2 < F.size(tokens), F.concat_ws(" ", t, F.get(tokens, i + 1), F.get(tokens, i + 2)))
            return F.when(F.array_contains(none, t), F.array().cast("array<string>")).otherwise(F.array(t, two, three))

        return F.flatten(F.transform(tokens, at))

    # The tokens are bound as a variable: written out, they would be found again for each of them.
    bound = F.flatten(F.transform(F.array(F.regexp_extract_all(line, F.lit(P.CAPITALIZED), F.lit(0))), grams))
    return F.filter(bound, lambda g: g.isNotNull() & ~F.array_contains(none, g))


def discover_aliases(docs: DataFrame, key: str, *, text_col: str = "text", min_count: int = 10) -> DataFrame:
    """(key, alias, n): the phrases that a document names at least min_count times."""
    lines = docs.select(key, F.explode(F.split(F.col(text_col), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]", -1)).alias("line"))
    return lines.select(key, F.explode(capitalized_grams(F.col("line"))).alias("alias")).groupBy(key, "alias").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def alias_order(aliases: Column) -> Column:
    """Distinct aliases, the longest first, equally long ones by code points."""
    keyed = F.transform(F.array_distinct(aliases), lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a")))
    return F.transform(F.array_sort(keyed), lambda s: s["a"])


def _quoted(a: Column) -> Column:
    return F.regexp_replace(a, r"([\\.\[\]{}()*+?^$|&~#\-\s])", r"\\$1")


def alias_pattern(aliases: Column, *, left_boundary: bool = False) -> Column:
    """One pattern for all aliases, the longest quoted one first; a mention ends before a non-word sign or at the end. Null if there are none."""
    kept = F.filter(aliases, lambda a: F.length(F.trim(a)) > 0)
    quoted = alias_order(F.transform(kept, _quoted))
    left = r"(?<!\w)" if left_boundary else ""
    return F.when(F.size(quoted) > 0, F.concat(F.lit(f"(?U){left}("), F.array_join(quoted, "|"), F.lit(r")(?=\W|$)")))


def _ending(mention: Column) -> Column:
    """What a collapsed mention keeps of its own ending: a possessive or plural s that belongs to the alias."""
    stub = F.lit(P.PLACEHOLDER)
    return F.when(mention.endswith("'s") | mention.endswith("’s"), F.concat(stub, F.lit("'s"))).when(mention.endswith("s"), F.concat(stub, F.lit("s"))).otherwise(stub)


def collapse_paragraph(paragraph: Column, pattern: Column, *, cap: int = 3) -> Column:
    """The first cap mentions of any alias stay, the others become the placeholder. All inside the row, without Python."""
    marked = F.call_function("regexp_replace", F.translate(paragraph, "\x01\x02", "  "), pattern, F.lit("\x01$1\x02"))
    parts = F.split(marked, "\x01", -1)

    def one(part: Column, i: Column) -> Column:
        mention = F.substring_index(part, "\x02", 1)
        rest = part.substr(F.length(mention) + 2, F.length(part))
        return F.when(i == 0, part).when(i <= cap, F.concat(mention, rest)).otherwise(F.concat(_ending(mention), rest))

    return F.when(pattern.isNull(), paragraph).otherwise(F.array_join(F.transform(parts, one), ""))


def collapse_mentions(text: Column, pattern: Column, *, cap: int = 3) -> Column:
    """collapse_paragraph on each paragraph; the blank lines between paragraphs stay as they are."""
    split = F.split(F.regexp_replace(F.translate(text, "\x03", " "), r"(?U)(\n\s*\n+)", "\x03$1\x03"), "\x03", -1)

    def with_pattern(bound: Column) -> Column:  # a variable: written out, the pattern would be put together for each paragraph
        return F.array_join(F.transform(split, lambda p, i: F.when(i % 2 == 0, collapse_paragraph(p, bound, cap=cap)).otherwise(p)), "")

    return F.when(pattern.isNull(), text).otherwise(F.element_at(F.transform(F.array(pattern), with_pattern), 1))


def collapse_entities(docs: DataFrame, aliases: DataFrame, key: str, *, ticker_col: str = "ticker", text_col: str = "text", heuristic_min: int | None = 10, cap: int = 3, left_boundary: bool = False) -> DataFrame:
    """docs with text_col collapsed by the ticker's aliases (ticker, alias) and, unless heuristic_min is None, discovered ones.

    Aliases of a ticker are one small row; the join is by ticker and Spark may broadcast it if it is small. Discovered
    aliases come by key. Tickers without aliases and texts without mentions stay as they are.
    """
    known = aliases.where("ticker is not null and alias is not null").groupBy("ticker").agg(F.collect_set("alias").alias("_known")).withColumnRenamed("ticker", "_ticker")
    df = docs.join(known, F.col(ticker_col) == F.col("_ticker"), "left").drop("_ticker")
    found = F.array().cast("array<string>")
    if heuristic_min is not None:
        own = discover_aliases(docs, key, text_col=text_col, min_count=heuristic_min).groupBy(key).agg(F.collect_list("alias").alias("_found")).withColumnRenamed(key, "_own")
        df = df.join(own, F.col(key) == F.col("_own"), "left").drop("_own")
        found = F.coalesce("_found", found)
    pattern = alias_pattern(F.concat(F.coalesce("_known", F.array().cast("array<string>")), found), left_boundary=left_boundary)
    out = df.withColumn("_pattern", pattern)
    return out.withColumn(text_col, collapse_mentions(F.col(text_col), F.col("_pattern"), cap=cap)).drop("_pattern", "_known", "_found")
