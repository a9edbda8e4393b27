"""The schema of each layer. Columns that a run may leave empty keep their types."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "date": T.DateType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields.items()])


SECTION_KEYS = ("1", "1A", "7", "7A")

BRONZE = _struct(ticker="s", year="i", section="s", text="s")
REPORT = _struct(
    ticker="s", year="i", status="s", details="s", source_doc="s",
    item_1="i", item_1A="i", item_7="i", item_7A="i",
    chars_1="i", chars_1A="i", chars_7="i", chars_7A="i", chars_total="i",
    short_1="i", short_1A="i", short_7="i", short_7A="i",
)
COVERAGE = _struct(ticker="s", years_total="l", years_ok_1a7="l")
SILVER = _struct(section="s", text="s", text_len="i", src="s", has_1="i", has_1A="i", has_7="i", has_7A="i", ticker="s", year="i")
GOLD_SECTION = _struct(
    ticker="s", fiscal_year="i", filing_date="s", accession="s", item="s", n_sentences="i",
    pos_mean="d", neu_mean="d", neg_mean="d", polarity="d", label="s", model="s",
    collapse_entities="b", brand_density_threshold="d", temperature="d",
)
GOLD_SENTENCE = _struct(
    ticker="s", fiscal_year="i", filing_date="s", accession="s", item="s", sent_idx="i", sentence="s",
    pos="d", neu="d", neg="d", weight="d", label="s", model="s", collapse_entities="b",
)
RETURNS = _struct(ticker="s", fiscal_year="i", filing_date="date", buy_date="date", ret_30d="d", ret_60d="d", ret_90d="d")
ALIASES = _struct(ticker="s", alias="s")
TICKER_MAP = _struct(ticker="s", cik_str="s")
SUBMISSIONS = _struct(form="s", filing_date="s", accession_number="s", primary_document="s")
