"""Coverage by ticker and the composed section dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from foliospark.functions import patterns as P
from foliospark.functions.text import first_n, join_nonempty, norm_label


def first_present(df: DataFrame, names: tuple[str, ...]) -> str | None:
    """The first of the names that df has as a column; decided when the plan is made."""
    return next((n for n in names if n in df.columns), None)


def covered(item_1a: Column, item_7: Column) -> Column:
    """Both sections are there; null counts as not there."""
    return F.coalesce(item_1a == 1, F.lit(False)) & F.coalesce(item_7 == 1, F.lit(False))


def fill_skipped(report: DataFrame, bronze: DataFrame) -> DataFrame:
    """report with the rows of status SKIP_EXISTS as OK, their flags item_* from the sections that bronze has of their year.

    A skipped year says nothing about its sections, but they are there; so parsing again changes no coverage.
    """
    flags = [c for c in report.columns if c.lower().startswith("item_")]
    label = {c: c[5:].upper() for c in flags}
    has = bronze.select("ticker", "year", norm_label(F.col("section")).alias("key")).groupBy("ticker", "year").agg(*[F.max((F.col("key") == label[c]).cast("int")).alias(f"_has_{c}") for c in flags])
    rows = report.join(has.withColumns({"ticker": F.col("ticker").cast("string"), "year": F.col("year").cast("int")}), ["ticker", "year"], "left")
    skipped = (F.col("status") == "SKIP_EXISTS") & F.coalesce(*[F.col(f"_has_{c}") for c in flags]).isNotNull()
    filled = {c: F.when(skipped, F.col(f"_has_{c}")).otherwise(F.col(c)) for c in flags} | {"status": F.when(skipped, F.lit("OK")).otherwise(F.col("status"))}
    return rows.select(*[filled.get(c, F.col(c)).alias(c) for c in report.columns])


def coverage(report: DataFrame, *, years: list[int] | None = None, item_1a: str = "item_1a", item_7: str = "item_7") -> DataFrame:
    """(ticker, years_total, years_ok_1a7) of the report rows with status OK; rows, not years, count as ok; null tickers are left out."""
    missing = {"ticker", "year", "status", item_1a, item_7} - set(report.columns)
    if missing:
        raise ValueError(f"the report lacks {sorted(missing)}")
    rows = report.where((F.col("status") == "OK") & F.col("ticker").isNotNull())
    if years:
        rows = rows.where(F.col("year").isin(sorted(set(years))))
    return rows.groupBy("ticker").agg(F.countDistinct("year").alias("years_total"), F.sum(covered(F.col(item_1a), F.col(item_7)).cast("bigint")).alias("years_ok_1a7"))


def covered_tickers(summary: DataFrame, *, min_years: int = 4) -> DataFrame:
    return summary.where(F.col("years_ok_1a7") >= min_years).select("ticker")


def _labelled(sections: DataFrame, keys: list[str], order_col: str | None) -> DataFrame | None:
    """(keys, key, row): each section under its key, row ordered so that the least one is the longest text.

    Of equal lengths the first by order_col counts, then the first by text. None without a section or a text column.
    """
    sec, txt, src = (first_present(sections, n) for n in (P.SECTION_COLUMNS, P.TEXT_COLUMNS, P.SOURCE_COLUMNS))
    if not sec or not txt:
        return None
    text = F.coalesce(F.col(txt), F.lit("None"))
    order = F.col(order_col) if order_col else F.lit(0)
    row = F.struct((-F.length(text)).alias("n"), order.alias("ord"), text.alias("text"), (F.col(src).cast("string") if src else F.lit("")).alias("src"))
    return sections.select(*keys, norm_label(F.col(sec)).alias("key"), row.alias("row")).where(F.col("key").isin(*P.SECTION_LABELS))


def _none(sections: DataFrame, keys: list[str], more: list[StructField]) -> DataFrame:
    return sections.sparkSession.createDataFrame([], StructType([*sections.select(*keys).schema.fields, *more]))


def longest_per_label(sections: DataFrame, keys: list[str], *, order_col: str | None = None) -> DataFrame:
    """(keys, key, text, src): for each of keys and section key the longest text, of equal ones the first by order_col or by text.

    The section and text columns are the first present ones of the known names; a null text counts as the text 'None'.
    Without a section or a text column there is nothing to choose from: an empty result. Each task sends on one text a group.
    """
    rows = _labelled(sections, keys, order_col)
    if rows is None:
        return _none(sections, keys, [StructField(n, StringType()) for n in ("key", "text", "src")])
    return rows.groupBy(*keys, "key").agg(F.min("row").alias("r")).select(*keys, "key", "r.text", "r.src")


def compose(sections: DataFrame, keys: list[str], *, carry_1: int = 800, carry_7a: int = 800, min_chars: int = 800, order_col: str | None = None) -> DataFrame:
    """(keys, section, text, text_len, src, has_1, has_1A, has_7, has_7A): sections 1A and 7 with the head of 1 before and of 7A after.

    A composed text under min_chars is given up for the section alone; nothing is dropped. The four sections of a report meet
    by one conditional aggregation, which is the only shuffle; each task sends on one text for each report and label.
    """
    rows = _labelled(sections, keys, order_col)
    if rows is None:
        return _none(sections, keys, [StructField(n, StringType()) for n in ("section", "text", "src")])
    wide = rows.groupBy(*keys).agg(*[F.min(F.when(F.col("key") == k, F.col("row"))).alias(f"r_{k}") for k in P.SECTION_LABELS])
    head, tail = first_n(F.col("r_1.text"), carry_1), first_n(F.col("r_7A.text"), carry_7a)

    def row(key: str) -> Column:
        main = F.col(f"r_{key}.text")
        joined = join_nonempty([head, main, tail], "\n\n")
        return F.struct(F.lit(key).alias("section"), F.when(F.length(joined) < min_chars, main).otherwise(joined).alias("text"), F.coalesce(F.col(f"r_{key}.src"), F.lit("")).alias("src"), main.isNotNull().alias("there"))

    flags = [F.col(f"r_{k}").isNotNull().cast("int").alias(f"has_{k}") for k in P.SECTION_LABELS]
    out = wide.select(*keys, *flags, F.explode(F.array(row("1A"), row("7"))).alias("r")).where("r.there")
    return out.select(*keys, "r.section", "r.text", F.length("r.text").alias("text_len"), "r.src", *[f"has_{k}" for k in P.SECTION_LABELS])


def build_silver(report: DataFrame, bronze: DataFrame, *, years: list[int] | None = None, min_years: int = 4, carry_1: int = 800, carry_7a: int = 800, min_chars: int = 800) -> DataFrame:
    """The section dataset of the covered tickers, in the silver schema's columns."""
    keep = covered_tickers(coverage(fill_skipped(report, bronze), years=years), min_years=min_years)
    rows = bronze.join(keep, "ticker", "left_semi")
    if years:
        rows = rows.where(F.col("year").isin(sorted(set(years))))
    return compose(rows, ["ticker", "year"], carry_1=carry_1, carry_7a=carry_7a, min_chars=min_chars)
