"""Queries over the scored layers: views, counts, distributions, look-ups and the join with returns."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession, name: str, path: str, *, persistent: bool = False) -> DataFrame:
    """A view over a Parquet path, replaced if it is there: temporary, or a table of the session's catalog that only points there."""
    if not persistent:
        df = spark.read.parquet(path)
        df.createOrReplaceTempView(name)
        return df
    quoted = "`" + name.replace("`", "``") + "`"
    spark.sql(f"drop table if exists {quoted}")  # an external table: the files stay
    spark.sql(f"create table {quoted} using parquet location '{path}'")
    return spark.table(quoted)


def try_sql(spark: SparkSession, text: str) -> tuple[DataFrame | None, str | None]:
    """(result, None), or (None, the first line of the error) for a query that cannot be parsed or planned."""
    try:
        return spark.sql(text), None
    except PySparkException as e:
        return None, str(e).strip().split("\n")[0]


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def label_distribution(df: DataFrame, by: str = "item", label: str = "label") -> DataFrame:
    """(by, label, n), ordered by the first and falling counts."""
    return df.groupBy(by, label).agg(F.count("*").alias("n")).orderBy(by, F.desc("n"), label)


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def peek(df: DataFrame, columns: list[str], order: list, n: int = 10) -> DataFrame:
    """The first n rows in a fixed order."""
    return df.select(*columns).orderBy(*order).limit(n)


def point_lookup(df: DataFrame, order: list, **equals) -> DataFrame:
    """At most one row with all these values, the first in order; an empty result if there is none."""
    for name, value in equals.items():
        df = df.where(F.col(name) == F.lit(value))
    return df.orderBy(*order).limit(1)


def sentiment_returns(sections: DataFrame, returns: DataFrame, items: tuple[str, ...] = ("1A", "7")) -> DataFrame:
    """Inner join on ticker and fiscal_year: a section has a row for each return of its ticker and year."""
    right = returns.select("ticker", "fiscal_year", "buy_date", "ret_30d", "ret_60d", "ret_90d")
    return sections.where(F.col("item").isin(*items)).join(right, ["ticker", "fiscal_year"])


def returns_from_prices(filings: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """(ticker, filing_date, buy_date, ret_<N>d): bought at the first price on or after filing, sold at the first N days later.

    An extension: the return producer's day rule is ours. filings has ticker and filing_date, prices ticker, day and price.
    Each look-up is an equi-join on ticker and day number within a week, so nothing is compared across a ticker's history.
    """
    clean = prices.where("ticker is not null and day is not null and price is not null").groupBy("ticker", "day").agg(F.min("price").alias("price"))
    base = filings.select("ticker", "filing_date").where("ticker is not null and filing_date is not null").distinct()

    def first_on_or_after(df: DataFrame, date_col: str, tag: str) -> DataFrame:
        ahead = df.select("ticker", date_col).distinct().withColumn("day", F.explode(F.sequence(F.col(date_col), F.date_add(F.col(date_col), 6))))
        hit = ahead.join(clean, ["ticker", "day"]).groupBy("ticker", date_col).agg(F.min(F.struct("day", "price")).alias(tag))
        return df.join(hit, ["ticker", date_col], "left")

    out = first_on_or_after(base, "filing_date", "buy").withColumn("buy_date", F.col("buy.day"))
    for n in horizons:
        out = first_on_or_after(out.withColumn("_due", F.date_add("buy_date", n)), "_due", "sell").withColumn(f"ret_{n}d", F.col("sell.price") / F.col("buy.price") - 1).drop("_due", "sell")
    return out.select("ticker", "filing_date", "buy_date", *[f"ret_{n}d" for n in horizons])
