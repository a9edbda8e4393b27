"""Lines repeated across the documents of one source (problem 5).

The documents of each line are kept as compressed bitmaps: a 64-bit word holds 64 neighbouring document ids, and only words
with a set bit exist. Spelling variants of a line (case, spacing, figures) have one canonical form; bit_or over that form
unites the variants' bitmaps, the bit counts add up to the exact number of documents, and a line of a document is deleted
if its bit is set in the bitmap of a line over the threshold.

The word number is part of every key that carries rows of documents, so a line that stands in a third of all documents is
spread over as many groups as there are words; the per-line totals are combined map-side before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import collapse_ws, norm_ticker
from foliospark.storage import materialize

SALTS = 16


def canonical_line(line: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed, each run of the digits 0-9 as one #."""
    return F.regexp_replace(F.trim(collapse_ws(F.lower(line))), "[0-9]+", "#")


def _occurrences(docs: DataFrame, id_col: str, source_col: str, text_col: str, min_chars: int) -> DataFrame:
    lines = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), norm_ticker(F.col(source_col)).alias("src"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line")
    ).where("src is not null and doc_id is not null")
    lines = lines.select("doc_id", "src", (F.col("line_no") + 1).alias("line_no"), F.xxhash64("line").alias("variant"), canonical_line(F.col("line")).alias("form"))
    return lines.where(F.length("form") >= min_chars).select(
        F.xxhash64("src", "form").alias("k1"),
        F.xxhash64("form", F.lit(7), "src").alias("k2"),
        F.shiftright("doc_id", 6).alias("word"),
        F.expr("shiftleft(1L, cast(doc_id & 63 as int))").alias("bit"),
        "doc_id",
        "line_no",
        "variant",
    )


def _bitmaps(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("k1", "k2", "word").agg(F.expr("bit_or(bit)").alias("bits"))


def _over_threshold(bitmaps: DataFrame, min_docs: int) -> DataFrame:
    return bitmaps.groupBy("k1", "k2").agg(F.sum(F.bit_count("bits")).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "ticker", text_col: str = "text", min_chars: int = 30, min_docs: int = 6) -> DataFrame:
    """(doc_id, line_no): each line whose canonical form has min_chars characters and stands in min_docs documents of its source.

    Lines stand between line feeds and count from 1, blank ones included. Sources compare trimmed and in upper case. Rows with
    a null source, id or text give nothing; a line that a document repeats, and a row that is there twice, counts as one
    document; an empty table gives no rows. Other columns are not read.
    """
    occurrences = _occurrences(docs, id_col, source_col, text_col, min_chars)
    bitmaps = materialize(_bitmaps(occurrences), "lines-bitmaps")
    often = _over_threshold(bitmaps, min_docs).select("k1", "k2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    kept = bitmaps.withColumn("salt", F.pmod("word", F.lit(SALTS)).cast("int")).join(often, ["k1", "k2", "salt"], "left_semi")
    kept = kept.select("k1", "k2", "word", "bits")
    return occurrences.join(kept, ["k1", "k2", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("doc_id", "line_no").distinct()


def remove_lines(docs: DataFrame, removed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_removed, text): each text without the lines of removed (doc_id, line_no); null texts stay null.

    The line numbers to drop travel to the documents, one array for each document; a text is never split over rows.
    """
    drop = removed.groupBy("doc_id").agg(F.collect_set("line_no").alias("_drop")).withColumnRenamed("doc_id", "_drop_id")
    joined = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text")).join(drop, F.col("doc_id") == F.col("_drop_id"), "left")
    kept = F.expr("array_join(filter(split(_text, '\\n', -1), (x, i) -> not array_contains(_drop, i + 1)), '\\n')")
    return joined.select("doc_id", F.coalesce(F.size("_drop"), F.lit(0)).alias("n_removed"), F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(kept).alias("text"))


def repeated_line_report(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "ticker", text_col: str = "text", min_chars: int = 30, min_docs: int = 6) -> DataFrame:
    """(ticker, line, n_docs, n_variants): each repeated line in its canonical form, its documents and its raw spellings.

    The bitmaps of raw spellings are united by canonical form. All of it is counted over hashes; each line over the threshold
    then names one of its places, and its text is taken from there. A row that is there twice counts
    once; different texts under one id would be taken for one document.
    """
    occurrences = _occurrences(docs, id_col, source_col, text_col, min_chars)
    spelled = occurrences.groupBy("k1", "k2", "variant", "word").agg(F.expr("bit_or(bit)").alias("bits"), F.min_by("line_no", "doc_id").alias("line_no"), F.min("doc_id").alias("doc_id"))
    spelled = materialize(spelled, "lines-spellings")
    united = spelled.groupBy("k1", "k2", "word").agg(F.expr("bit_or(bits)").alias("bits"), F.min_by("line_no", "doc_id").alias("line_no"), F.min("doc_id").alias("doc_id"))
    often = united.groupBy("k1", "k2").agg(F.sum(F.bit_count("bits")).alias("n_docs"), F.min_by("line_no", "doc_id").alias("line_no"), F.min("doc_id").alias("doc_id")).where(F.col("n_docs") >= min_docs)
    variants = spelled.groupBy("k1", "k2", "variant").agg(F.lit(1).alias("one")).groupBy("k1", "k2").agg(F.count("*").alias("n_variants"))
    kept = often.join(variants, ["k1", "k2"]).groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "n_docs", "n_variants")).alias("_own")).withColumnRenamed("doc_id", "_at")
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), norm_ticker(F.col(source_col)).alias("ticker"), F.col(text_col).alias("_text")).where("ticker is not null and _text is not null")
    named = texts.join(kept, F.col("_id") == F.col("_at")).select("ticker", F.split("_text", "\n", -1).alias("_lines"), F.explode("_own").alias("o"))
    return named.select("ticker", canonical_line(F.element_at("_lines", F.col("o.line_no"))).alias("line"), "o.n_docs", "o.n_variants").distinct()
