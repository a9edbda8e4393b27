"""Readers and writers of the layers: raw pages, tables, alias maps, ticker lists, resumable sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.functions.text import trim_ws
from foliospark.operators.documents import decode_page


def read_pages(spark: SparkSession, base: str, *, tickers: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
    """(ticker, year, path, name, size, text) of all pages under base/<TICKER>/<YEAR>/; bytes that are no UTF-8 are dropped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{htm,html,HTM,HTML}").load(base)
    at = lambda n: F.regexp_extract("path", r"/([^/]+)/(\d+)/([^/]+)$", n)
    rows = raw.select(at(1).alias("ticker"), F.expr("try_cast(nullif(regexp_extract(path, '/([^/]+)/(\\\\d+)/([^/]+)$', 2), '') as int)").alias("year"), "path", at(3).alias("name"), F.col("length").alias("size"), "content")
    rows = rows.where("year is not null")
    if tickers:
        rows = rows.where(F.col("ticker").isin(tickers))
    if years:
        rows = rows.where(F.col("year").isin(sorted(set(years))))
    return rows.select("ticker", "year", "path", "name", "size", decode_page(F.col("content")).alias("text"))


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of a file, a folder or a glob as one table by column name; columns that a file lacks are null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def read_tickers(spark: SparkSession, *, listed: str | None = None, path: str | None = None) -> DataFrame:
    """(ticker): a comma list if given, else the lines of a file; trimmed, in upper case, without blanks and # comments."""
    if listed:
        rows = spark.range(1).select(F.explode(F.split(F.lit(listed), ",")).alias("value"))
    elif path:
        rows = spark.read.text(path)
    else:
        raise ValueError("neither a list nor a file of tickers")
    return rows.select(F.upper(trim_ws(F.col("value"))).alias("ticker")).where("ticker <> '' and not startswith(ticker, '#')")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The parse report from CSV; counts with blanks are null. Names compare without regard to case."""
    return spark.read.csv(path, header=True, schema=schemas.REPORT, nullValue="", quote='"', escape='"', multiLine=True)


def read_aliases(spark: SparkSession, path: str | None) -> DataFrame:
    """(ticker, alias) from JSON {ticker: [aliases]} or CSV with these columns; empty without a path."""
    if not path:
        return spark.createDataFrame([], schemas.ALIASES)
    if path.lower().endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
        return whole.select(F.explode("m").alias("ticker", "all")).select("ticker", F.explode("all").alias("alias"))
    if path.lower().endswith(".csv"):
        rows = spark.read.csv(path, header=True)
        if not {"ticker", "alias"} <= set(rows.columns):
            raise ValueError("an alias file needs the columns ticker and alias")
        return rows.select("ticker", "alias")
    raise ValueError("an alias file is .json or .csv")


def write_new_partitions(df: DataFrame, path: str, keys: tuple[str, ...] = ("ticker", "year"), *, overwrite: bool = False) -> None:
    """Writes Parquet by keys; partitions that are there stay untouched, or are replaced one by one with overwrite."""
    spark = df.sparkSession
    if not overwrite and exists(spark, path):
        there = spark.read.parquet(path).select(*keys).distinct()
        df = df.join(there, list(keys), "left_anti")
    writer = df.write.partitionBy(*keys).option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite" if overwrite else "append").parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys are not at path yet, compressed with zstd; a second run with the same rows adds nothing.

    Of rows with the same keys one is appended; null keys are keys like any other. Of the target only the keys are read. Two
    writers at once may both add the same keys: one stream, or one job, writes a target.
    """
    spark = df.sparkSession
    df = df.dropDuplicates(keys)
    if exists(spark, path):
        there = spark.read.parquet(path).select(*[F.col(k).alias(f"_there_{k}") for k in keys]).distinct()
        df = df.join(there, [F.col(k).eqNullSafe(F.col(f"_there_{k}")) for k in keys], "left_anti")
    df.write.mode("append").option("compression", "zstd").parquet(path)


def write_both(df: DataFrame, path: str) -> None:
    """The same rows as Parquet and as CSV, computed once."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    df.sparkSession.read.parquet(f"{path}.parquet").write.mode("overwrite").csv(f"{path}.csv", header=True, quote='"', escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_lines(df: DataFrame, col: str, path: str) -> None:
    """One value a line in one file, sorted; for short lists."""
    df.select(F.col(col).cast("string").alias("value")).orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def real_filing_date(name: Column) -> Column:
    """The filing date in a raw page's name <TICKER>_<date>_<accession><ext>, null if there is none."""
    return F.try_to_date(F.nullif(F.regexp_extract(name, r"_(\d{4}-\d{2}-\d{2})_", 1), F.lit("")))
