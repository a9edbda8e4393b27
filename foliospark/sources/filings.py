"""Filing metadata over HTTP or from recorded files: ticker map, submissions with older pages, document addresses, downloads."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from urllib import error, request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliospark.functions.text import safe_name, zero_fill

RETRY_ON = (429, 500, 502, 503, 504)


def fetch(url: str, *, agent: str = "research contact@example.org", timeout: float = 30, retries: int = 5, backoff: float = 0.5) -> bytes | None:
    """The body of a GET, with retries and growing pauses on the usual passing failures; None for any other status."""
    for attempt in range(retries + 1):
        try:
            with request.urlopen(request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
                return r.read()
        except error.HTTPError as e:
            if e.code not in RETRY_ON or attempt == retries:
                return None
        except error.URLError:
            if attempt == retries:
                return None
        time.sleep(backoff * 2**attempt)
    return None


class _Part(InputPartition):
    def __init__(self, urls: list[str], lanes: int):
        self.urls, self.lanes = urls, lanes


class _JsonReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        urls = [u for u in self.options.get("urls", "").split("\n") if u]
        n = max(1, min(len(urls), int(self.options.get("partitions", "8"))))
        return [_Part(urls[k::n], n) for k in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        pause = float(self.options.get("pause", "0.35")) * partition.lanes  # so that the job as a whole keeps the rate
        for url in partition.urls:
            body = fetch(url, timeout=float(self.options.get("timeout", "30")))
            yield url, None if body is None else body.decode("utf-8", "replace")
            if not url.startswith("file:"):
                time.sleep(pause)


class JsonPages(DataSource):
    """format("json_pages"): (url, body) for each line of the option urls; a page that cannot be had has a null body."""

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _JsonReader(dict(self.options))


def read_json_pages(spark: SparkSession, urls: list[str], **options) -> DataFrame:
    spark.dataSource.register(JsonPages)
    return spark.read.format("json_pages").options(urls="\n".join(urls), **options).load()


def ticker_map(pages: DataFrame) -> DataFrame:
    """(ticker, cik_str) from {any: {ticker, cik_str}}: tickers in upper case, numbers filled with zeros to ten digits."""
    rows = pages.select(F.explode(F.map_values(F.from_json("body", "map<string,struct<ticker:string,cik_str:string>>"))).alias("x"))
    return rows.select(F.upper("x.ticker").alias("ticker"), zero_fill(F.col("x.cik_str"), 10).alias("cik_str"))


_ARRAYS = "form:array<string>,filingDate:array<string>,accessionNumber:array<string>,primaryDocument:array<string>"


def zip_rows(form: Column, date: Column, accession: Column, document: Column) -> Column:
    """array<struct>: the arrays side by side, as long as the shortest one (arrays_zip would fill up with nulls)."""
    n = F.least(*[F.coalesce(F.size(a), F.lit(0)) for a in (form, date, accession, document)])
    at = lambda a, i: F.get(a, i)
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(form, i).alias("form"), at(date, i).alias("filing_date"), at(accession, i).alias("accession_number"), at(document, i).alias("primary_document")))
    return F.when(n > 0, rows).otherwise(F.array().cast("array<struct<form:string,filing_date:string,accession_number:string,primary_document:string>>"))


def submission_rows(pages: DataFrame) -> DataFrame:
    """(url, form, filing_date, accession_number, primary_document) of main and older pages; both the nested and the flat shape are read."""
    nested = F.from_json("body", f"struct<filings:struct<recent:struct<{_ARRAYS}>>,{_ARRAYS}>")
    df = pages.where("body is not null").select("url", nested.alias("j"))
    pick = lambda n: F.coalesce(F.col(f"j.filings.recent.{n}"), F.col(f"j.{n}"))
    return df.select("url", F.inline(zip_rows(pick("form"), pick("filingDate"), pick("accessionNumber"), pick("primaryDocument"))))


def older_pages(pages: DataFrame) -> DataFrame:
    """(url, name) of the further pages that a main page lists."""
    names = F.from_json("body", "struct<filings:struct<files:array<struct<name:string>>>>")["filings"]["files"]["name"]
    return pages.select("url", F.explode(names).alias("name"))


def filing_day(date: Column) -> Column:
    """The day of a filing date written yyyy-MM-dd or yyyyMMdd, null for any other."""
    return F.coalesce(F.try_to_date(date, "yyyy-MM-dd"), F.try_to_date(date, "yyyyMMdd"))


def annual_reports(rows: DataFrame, *, start: str = "2020-01-01", end: str = "2024-12-31", form: str = "10-K", date_col: str = "filing_date") -> DataFrame:
    """Rows of exactly this form filed between the days, both included; dates that are none are left out."""
    day = filing_day(F.col(date_col))
    return rows.where((F.col("form") == form) & day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def document_url(base: str, cik: Column, accession: Column, document: Column) -> Column:
    return F.concat_ws("/", F.lit(base.rstrip("/")), F.ltrim(cik, F.lit("0")), F.replace(accession, F.lit("-"), F.lit("")), document)


def raw_name(ticker: Column, date: Column, accession: Column, document: Column) -> Column:
    """<ticker>_<date>_<accession> with the document's extension, .html without one; safe for a file name."""
    ext = F.regexp_extract(document, r"(\.[^./]+)$", 1)
    return safe_name(F.concat(F.concat_ws("_", ticker, date, accession), F.when(ext == "", ".html").otherwise(ext)))


def download(documents: DataFrame, outdir: str, *, pause: float = 0.35, timeout: float = 60, lanes: int = 1) -> DataFrame:
    """(url, path, ok): documents has url, ticker, year and name; bodies go to outdir/<ticker>/<year>/<name>.

    A file that is there and not empty counts as done and is not fetched. Failures leave ERROR_<name>.txt. outdir is a folder,
    or an address of a file system that Arrow knows, that all executors reach. The job as a whole asks once in pause seconds:
    each of the lanes waits lanes times as long.
    """

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(outdir) if "://" in outdir else (fs.LocalFileSystem(), outdir.removeprefix("file:"))

        def put(path: str, body: bytes) -> None:
            part = f"{path}.{os.getpid()}.part"
            with store.open_output_stream(part) as f:
                f.write(body)
            store.move(part, path)

        for df in batches:
            out = []
            for url, ticker, year, name in zip(df["url"], df["ticker"], df["year"], df["name"]):
                folder = f"{root}/{ticker}/{year}"
                to = f"{folder}/{name}"
                there = store.get_file_info(to)
                if there.is_file and there.size:
                    out.append((url, to, True))
                    continue
                store.create_dir(folder, recursive=True)
                body = fetch(url, timeout=timeout)
                if body:
                    put(to, body)
                else:
                    put(f"{folder}/ERROR_{name}.txt", json.dumps({"url": url}).encode())
                out.append((url, to, bool(body)))
                if not url.startswith("file:"):
                    time.sleep(pause * lanes)
            yield pd.DataFrame(out, columns=["url", "path", "ok"])

    return documents.select("url", "ticker", "year", "name").repartition(lanes).mapInPandas(run, "url string, path string, ok boolean")


def download_totals(done: DataFrame) -> DataFrame:
    """(n_ok, n_failed) of what download returns."""
    return done.agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))
