import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int'}" for k, v in values.items()))
    return df.select(column.alias("x")).head()[0]


def test_trim_and_collapse_know_unicode_white_space(spark):
    assert one(spark, T.trim_ws(F.col("s")), s="  　\ta b \n") == "a b"
    assert one(spark, T.collapse_ws(F.col("s")), s="a \n b") == "a b"
    assert one(spark, T.norm_ticker(F.col("s")), s=" abc ") == "ABC"
    assert one(spark, T.norm_ticker(F.col("s")), s=None) is None
    assert one(spark, T.is_blank(F.col("s")), s=" ") is True
    assert one(spark, T.is_blank(F.col("s")), s=None) is True


def test_first_n_and_join(spark):
    assert one(spark, T.first_n(F.col("s"), 2), s="\U0001f4c8ab") == "\U0001f4c8a"
    assert one(spark, T.first_n(F.col("s"), 0), s="abc") == ""
    assert one(spark, T.first_n(F.col("s"), 3), s=None) == ""
    assert one(spark, T.join_nonempty([F.lit(""), F.col("s"), F.lit(None).cast("string"), F.lit("b")], "--"), s="a") == "a--b"


def test_labels(spark):
    cases = {"1A.": "1a ", "item 15": "1", "Item-7A": "7A", "Item 7": "7", " ITEM_1A: x": "1A", "item1": "1", "7a": "7A", "": "", None: "none"}
    for raw, want in cases.items():
        assert one(spark, T.norm_label(F.col("s")), s=raw) == want, raw
    items = {"Item 1A": "1A", "ITEM 7.": "7", "item 10": "10", "ITEM7A.": "7A", " 7 ": "7", None: None}
    for raw, want in items.items():
        assert one(spark, T.norm_item(F.col("s")), s=raw) == want, raw


def test_zero_fill_never_cuts(spark):
    assert one(spark, T.zero_fill(F.col("s"), 10), s="123") == "0000000123"
    assert one(spark, T.zero_fill(F.col("s"), 3), s="12345") == "12345"


def test_summarize_cuts_with_ellipsis_only_if_longer(spark):
    assert one(spark, T.summarize(F.col("s"), 3), s=" a  b ") == "a b"
    assert one(spark, T.summarize(F.col("s"), 3), s="a b c") == "a b…"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="a.I \n\U0001f4c8é1\x01", max_size=40), min_size=1, max_size=8))
def test_match_starts_are_the_offsets_of_finditer(spark, texts):
    pattern = r"(a1?|I)"
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, s string")
    got = {r[0]: r[1] for r in df.select("k", T.match_starts(F.col("s"), pattern)).collect()}
    for k, t in enumerate(texts):
        assert got[k] == [m.start() for m in re.finditer(pattern, t)]
