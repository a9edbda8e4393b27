"""The five stages from files to files: ingest, parse, build, score and diagnose. Keyword arguments are their options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.functions import patterns as P
from foliospark.operators import documents, scoring, sections, silver
from foliospark.sources import files, filings
from foliospark.storage import discard, materialize


def ingest(spark: SparkSession, *, tickers: str | None = None, tickers_file: str | None = "tickers.txt", map_url: str, submissions_url: str, documents_url: str, start: str = "2020-01-01", end: str = "2024-12-31", outdir: str = "data/raw", sleep: float = 0.35) -> DataFrame:
    """(url, path, ok) of the annual reports of the tickers filed in the period; tickers without a number are left out.

    The addresses are templates: submissions_url has {cik} or {name}, documents_url is the base of document addresses.
    """
    wanted = files.read_tickers(spark, listed=tickers, path=None if tickers else tickers_file)
    known = filings.ticker_map(filings.read_json_pages(spark, [map_url], pause=sleep))
    named = [tuple(r) for r in wanted.join(known, "ticker").select("ticker", "cik_str").distinct().collect()]
    main_urls = {submissions_url.format(cik=cik, name=f"CIK{cik}.json"): (t, cik) for t, cik in named}
    main = materialize(filings.read_json_pages(spark, list(main_urls), pause=sleep), "ingest-main")
    older = {submissions_url.format(cik=main_urls[r["url"]][1], name=r["name"]): main_urls[r["url"]] for r in filings.older_pages(main).collect()}
    pages = main.unionByName(filings.read_json_pages(spark, list(older), pause=sleep)) if older else main
    owners = spark.createDataFrame([(u, *o) for u, o in (main_urls | older).items()], "url string, ticker string, cik string")
    rows = filings.annual_reports(filings.submission_rows(pages).join(owners, "url"), start=start, end=end)
    asked = rows.select(
        filings.document_url(documents_url, F.col("cik"), F.col("accession_number"), F.col("primary_document")).alias("url"),
        "ticker", F.year(filings.filing_day(F.col("filing_date"))).alias("year"), filings.raw_name(F.col("ticker"), F.col("filing_date"), F.col("accession_number"), F.col("primary_document")).alias("name"),
    )
    return filings.download(asked, outdir, pause=sleep)


def scored_pages(spark: SparkSession, raw_base: str, *, tickers: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
    """(ticker, year, path, name, size, text, score): every raw page with its score."""
    pages = files.read_pages(spark, raw_base, tickers=tickers, years=years)
    plain = documents.plain_text(F.col("text"))
    return pages.withColumn("_plain", plain).withColumn("score", documents.page_score(F.col("_plain"), F.col("size"), F.col("name"))).drop("_plain")


def best_pages(spark: SparkSession, raw_base: str, skip: DataFrame | None = None, *, tickers: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
    """(ticker, year, path, name, size, text) of the best page of each year but those of skip (ticker, year).

    Pages are chosen by their scores and paths alone; only then the winners are read, and no page is sorted or grouped.
    """
    scores = scored_pages(spark, raw_base, tickers=tickers, years=years).select("ticker", "year", "path", "score")
    if skip is not None:
        scores = scores.join(skip, ["ticker", "year"], "left_anti")
    best = materialize(documents.best_page(scores, ["ticker", "year"]).select("path"), "best-pages")
    return files.read_pages(spark, raw_base, tickers=tickers, years=years).join(best, "path", "left_semi").select("ticker", "year", "path", "name", "size", "text")


def parse(spark: SparkSession, *, raw_base: str = "data/raw", out_base: str = "data/bronze", tickers: list[str] | None = None, years: list[int] | None = None, overwrite: bool = False, report: str | None = None, min_chars: dict[str, int] | None = None, with_dates: bool = False) -> DataFrame:
    """Writes the sections of each ticker and year to out_base and returns (and writes) the report, in its schema's columns.

    Years that are there already are skipped (SKIP_EXISTS) unless overwrite; a folder without a page is NO_HTML; a page that
    cannot be parsed is ERROR, with what went wrong in details, and stops nothing. Only the best page of each year goes on from
    the score. with_dates: the sections also have the filing date that the page's name tells.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(raw_base).select("path")
    at = lambda n: F.regexp_extract("path", r"/([^/]+)/(\d+)/[^/]+$", n)
    every = raw.select(at(1).alias("ticker"), at(2).alias("y")).where("y <> ''").select("ticker", F.col("y").cast("int").alias("year")).distinct()
    if tickers:
        every = every.where(F.col("ticker").isin(tickers))
    if years:
        every = every.where(F.col("year").isin(sorted(set(years))))
    there = spark.createDataFrame([], "ticker string, year int")
    if not overwrite and files.exists(spark, out_base):
        there = spark.read.parquet(out_base).select(F.col("ticker").cast("string").alias("ticker"), F.col("year").cast("int").alias("year")).distinct()
    read = best_pages(spark, raw_base, there, tickers=tickers, years=years).withColumn("p", documents.parse_page(F.col("text")))
    best = materialize(read.select("ticker", "year", "name", "path", documents.tidy_lines(F.col("p.text")).alias("text"), "p.error"), "parse-text")
    keys = ("ticker", "year", "name", "path", "error")
    found = materialize(sections.find_sections(best, *keys, min_chars=min_chars), "parse-sections")
    discard(best)
    bronze = sections.section_rows(found, *keys).select("ticker", "year", F.concat(F.lit("Item "), F.col("section")).alias("section"), "text", *([files.real_filing_date(F.col("name")).alias("filing_date")] if with_dates else []))
    files.write_new_partitions(bronze, out_base, overwrite=overwrite)

    rows = sections.report_rows(found, *keys, min_chars=min_chars)
    rows = rows.withColumn("status", F.when(F.col("status") == "NO_HTML", "ERROR").otherwise(F.col("status"))).withColumn("path", F.concat_ws(": ", "path", "error")).drop("error")
    done = there.withColumn("skipped", F.lit(True))
    joined = every.join(done, ["ticker", "year"], "left").join(rows, ["ticker", "year"], "left")
    status = F.when(F.col("skipped"), "SKIP_EXISTS").when(F.col("status").isNull(), "NO_HTML").otherwise(F.col("status"))
    out = joined.select("ticker", "year", status.alias("status"), F.col("path").alias("details"), F.col("name").alias("source_doc"), *[F.col(f.name.lower()).alias(f.name) for f in schemas.REPORT.fields[5:]])
    if report:
        files.write_csv(out.orderBy("ticker", "year"), report)
    return out


def build(spark: SparkSession, *, report: str, bronze: str = "data/bronze", years: list[int] | None = None, min_years: int = 4, carry_1: int = 800, carry_7a: int = 800, min_chars: int = 800, outdir: str = "data/silver") -> DataFrame:
    """Writes the covered tickers, the coverage summary and the composed dataset (Parquet and CSV) to outdir; returns the dataset.

    Years that a later parse skipped count by the sections that are there.
    """
    source = spark.read.parquet(bronze)
    rows = silver.fill_skipped(files.read_report(spark, report), source)
    summary = materialize(silver.coverage(rows, years=years, item_1a="item_1A", item_7="item_7"), "coverage")
    files.write_csv(summary.orderBy(F.desc("years_ok_1a7"), "ticker"), f"{outdir}/coverage")
    keep = silver.covered_tickers(summary, min_years=min_years)
    files.write_lines(keep, "ticker", f"{outdir}/tickers")
    chosen = source.join(keep, "ticker", "left_semi")
    if years:
        chosen = chosen.where(F.col("year").isin(sorted(set(years))))
    data = silver.compose(chosen, ["ticker", "year"], carry_1=carry_1, carry_7a=carry_7a, min_chars=min_chars)
    data = data.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.SILVER.fields])
    files.write_both(data, f"{outdir}/dataset")
    return spark.read.parquet(f"{outdir}/dataset.parquet")


def score(spark: SparkSession, *, silver_path: str, outdir: str = "data/gold", emit_sentences: bool = False, resume: bool = False, aliases: str | None = None, by_model: bool = False, **options) -> DataFrame:
    """Appends section scores (and sentence scores) to outdir; with resume only sections that are not there. Returns the new section rows.

    The scorer sees each sentence once: its scores are a written table, and section and sentence rows come from that. by_model:
    a section counts as there only with the same model. options are those of scoring.scored_sentences, and temperature.
    """
    rows = files.read_tables(spark, silver_path)
    target = f"{outdir}/section_scores"
    model = options.pop("model", "lexicon")
    temperature = options.pop("temperature", None)
    keys = [*scoring.KEYS, "model"] if by_model else scoring.KEYS
    done = spark.read.parquet(target) if resume and files.exists(spark, target) else None
    if by_model and done is not None:
        done = done.where(F.col("model") == F.lit(model))
    known = files.read_aliases(spark, aliases) if aliases else None
    scored = materialize(scoring.scored_sentences(rows, aliases=known, done=done, **options), "score-sentences")
    collapsed = options.get("collapse", False)
    gold = scoring.aggregate_sections(scored, model=model, collapsed=collapsed, threshold=options.get("threshold", 0.25), temperature=temperature)
    gold = materialize(gold, "score-sections")
    if emit_sentences:
        files.append_new(scoring.sentence_rows(scored, model=model, collapsed=collapsed), f"{outdir}/sentence_scores", [*keys, "sent_idx"])
    files.append_new(gold, target, keys)
    discard(scored)
    return gold


def diagnose(spark: SparkSession, *, raw_base: str = "data/raw", ticker: str, year: int, top_k: int = 5, all_labels: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pages by score, ranked section candidates of the best page) of one ticker and year; labels 1A, 7 and 7A, or all."""
    pages = scored_pages(spark, raw_base, tickers=[ticker], years=[year])
    best = best_pages(spark, raw_base, tickers=[ticker], years=[year]).withColumn("text", documents.document_lines(F.col("text")))
    labels = P.SECTION_LABELS if all_labels else ("1A", "7", "7A")
    ranked = sections.diagnose(best, "ticker", "year", top_k=top_k).where(F.col("label").isin(*labels))
    return pages.select("name", "size", "score").orderBy(F.desc("score"), "name").limit(top_k), ranked
