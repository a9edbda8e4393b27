import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.operators import analytics, entities, scoring, sentences, silver


def test_coverage_counts_rows_and_skips_null_tickers(spark):
    rows = [("A", 2020, "OK", 1, 1), ("A", 2020, "OK", 1, 1), ("A", 2021, "OK", None, 1), ("A", 2022, "ERROR", 1, 1), (None, 2020, "OK", 1, 1), ("B", 2020, "OK", 1, 0)]
    report = spark.createDataFrame(rows, "ticker string, year int, status string, item_1a int, item_7 int")
    got = {r["ticker"]: (r["years_total"], r["years_ok_1a7"]) for r in silver.coverage(report).collect()}
    assert got == {"A": (2, 2), "B": (1, 0)}
    assert [r[0] for r in silver.covered_tickers(silver.coverage(report), min_years=2).collect()] == ["A"]
    assert silver.coverage(report, years=[2021]).head()["years_ok_1a7"] == 0
    with pytest.raises(ValueError):
        silver.coverage(report.drop("item_7"))


def test_compose_carries_and_reverts(spark):
    rows = [("A", 2020, "Item 1", "b" * 10), ("A", 2020, "Item 1A", "r" * 20), ("A", 2020, "Item 1A", "q" * 20), ("A", 2020, "Item 7A", "m" * 10), ("B", 2020, "Item 7", "x"), ("C", 2020, "Item 1", "only")]
    bronze = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "ticker string, year int, section string, text string, k int")
    got = {(r["ticker"], r["section"]): r for r in silver.compose(bronze, ["ticker", "year"], carry_1=4, carry_7a=3, min_chars=5, order_col="k").collect()}
    assert set(got) == {("A", "1A"), ("B", "7")}
    assert got["A", "1A"]["text"] == "bbbb\n\n" + "r" * 20 + "\n\nmmm" and got["A", "1A"]["has_7"] == 0
    assert got["B", "7"]["text"] == "x" and got["B", "7"]["text_len"] == 1
    short = silver.compose(bronze, ["ticker", "year"], carry_1=4, carry_7a=3, min_chars=500, order_col="k").where("ticker = 'A'").head()
    assert short["text"] == "r" * 20


def plain_collapse(paragraph, aliases, cap):
    kept = sorted((re.escape(a) for a in aliases if a.strip()), key=lambda s: (-len(s), s))
    n = 0

    def put(m):
        nonlocal n
        n += 1
        s = m.group(0)
        if n <= cap:
            return s
        return "<BRAND>" + ("'s" if s.endswith(("'s", "’s")) else "s" if s.endswith("s") else "")

    return re.sub("(" + "|".join(kept) + r")(?=[^\w]|$)", put, paragraph) if kept else paragraph


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["Acme", "Acme Corp.", "Widgets", "Bolt's", "GE", "CHANGE", "and", "é", "Acmes", "C++", "."]), max_size=14), min_size=1, max_size=6), st.integers(0, 3))
def test_collapse_equals_the_plain_way(spark, rows, cap):
    aliases = ["Acme", "Acme Corp.", "Widgets", "Bolt's", "GE", "C++"]
    texts = [" ".join(r) for r in rows]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    pattern = entities.alias_pattern(F.array(*[F.lit(a) for a in aliases]))
    got = {r[0]: r[1] for r in df.select("k", entities.collapse_mentions(F.col("text"), pattern, cap=cap)).collect()}
    assert got == {k: plain_collapse(t, aliases, cap) for k, t in enumerate(texts)}


def test_collapse_counts_by_paragraph_and_keeps_blank_lines(spark):
    docs = spark.createDataFrame([(1, "T", "Acme Acme\n \n\nAcme Acme Acme"), (2, "U", "Acme Acme Acme"), (3, None, None)], "k int, ticker string, text string")
    aliases = spark.createDataFrame([("T", "Acme"), (None, "x")], "ticker string, alias string")
    got = {r["k"]: r["text"] for r in entities.collapse_entities(docs, aliases, "k", heuristic_min=None, cap=2).collect()}
    assert got == {1: "Acme Acme\n \n\nAcme Acme <BRAND>", 2: "Acme Acme Acme", 3: None}


def test_discovery_counts_grams_over_capitalized_tokens(spark):
    docs = spark.createDataFrame([(1, "Big Corp met SEC and Big small Corp\nBig Corp")], "k int, text string")
    got = {r["alias"]: r["n"] for r in entities.discover_aliases(docs, "k", min_count=1).collect()}
    assert got["Big"] == 3 and got["Big Corp"] == 3 and "SEC" not in got and got["Corp SEC"] == 1 and got["Big Corp SEC"] == 1


def plain_merge(sents, least):
    out, buf = [], ""
    for t in (s.strip() for s in sents):
        if not t:
            continue
        if len(t) < least:
            buf = (buf + " " + t).strip()
        else:
            out.append((buf + " " + t).strip())
            buf = ""
    return [*out, buf] if buf else out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab \U0001f4c8", max_size=12), max_size=8), min_size=1, max_size=6))
def test_merge_equals_a_fold(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "k int, s array<string>")
    got = {r[0]: r[1] for r in df.select("k", sentences.merge_fragments(F.col("s"), 5)).collect()}
    assert got == {k: plain_merge(r, 5) for k, r in enumerate(rows)}


def test_weights_and_retune(spark):
    df = spark.createDataFrame([("<BRAND> a b c",), ("<BRAND> a b",), ("<BRAND>",), ("a",)], "s string")
    assert [round(r[0], 6) for r in df.select(sentences.brand_weight(F.col("s"))).collect()] == [1.0, 0.9, 0.2, 1.0]
    base = spark.range(1)
    p, u, n = scoring.retune(F.lit(0.7), F.lit(0.2), F.lit(0.1), 1.0)
    assert [round(x, 3) for x in base.select(p, u, n).head()] == [0.866, 0.093, 0.041]
    p, u, n = scoring.retune(F.lit(0.0), F.lit(1.0), F.lit(0.0), 0.85)
    assert abs(sum(base.select(p, u, n).head()) - 1) < 1e-9
    assert scoring.retune(1, 2, 3, None) == [1, 2, 3] and scoring.retune(1, 2, 3, 0) == [1, 2, 3]
    with pytest.raises(ValueError):
        scoring.retune(F.lit(1), F.lit(1), F.lit(1), -1)
    ties = [(0.5, 0.5, 0.0, "positive"), (0.2, 0.4, 0.4, "neutral"), (1 / 3, 1 / 3, 1 / 3, "positive"), (0.1, 0.2, 0.7, "negative")]
    for a, b, c, want in ties:
        assert base.select(scoring.label_of(F.lit(a), F.lit(b), F.lit(c))).head()[0] == want


def test_scoring_with_a_scorer_resume_and_blank_texts(spark):
    silver_rows = spark.createDataFrame([("A", 2020, "1A", "We gained a lot in this very good year. And it was a strong growth for all of us."), ("A", 2020, "7", " \n"), ("A", 2020, "Item 10", "x"), ("A", 2021, "7", None)], "ticker string, year int, section string, text string")

    def make():
        return lambda batch: [(0.6, 0.3, 0.1) if "gained" in s else (0.2, 0.2, 0.6) for s in batch]

    gold, per_sentence = scoring.score_sections(silver_rows, make_scorer=make, model="m", temperature=None)
    row = gold.collect()
    assert len(row) == 1 and row[0]["n_sentences"] == 2 and abs(row[0]["pos_mean"] - 0.4) < 1e-9 and row[0]["accession"] == "A-2020" and row[0]["filing_date"] == "2020-01-01" and row[0]["temperature"] is None
    assert [r["sent_idx"] for r in per_sentence.orderBy("sent_idx").collect()] == [0, 1]
    again, _ = scoring.score_sections(silver_rows, make_scorer=make, model="m", done=gold)
    assert again.count() == 0
    assert scoring.scores_to_vector([{"label": "Negative", "score": 0.9}]) == (0.0, 0.0, 0.9)
    with pytest.raises(ValueError):
        scoring.prepare(silver_rows.drop("text"))


def test_returns_and_lookup(spark):
    import datetime as dt

    d = dt.date
    filings = spark.createDataFrame([("A", d(2020, 1, 3)), ("A", d(2020, 1, 3)), ("B", d(2020, 1, 3)), (None, d(2020, 1, 3))], "ticker string, filing_date date")
    prices = spark.createDataFrame([("A", d(2020, 1, 6), 10.0), ("A", d(2020, 2, 6), 12.0)], "ticker string, day date, price double")
    rows = {r["ticker"]: r for r in analytics.returns_from_prices(filings, prices, (30,)).collect()}
    assert rows["A"]["buy_date"] == d(2020, 1, 6) and abs(rows["A"]["ret_30d"] - 0.2) < 1e-9 and rows["B"]["buy_date"] is None
    assert analytics.point_lookup(prices, ["day"], ticker="nobody").count() == 0


def test_sections_without_ticker_or_year_are_scored(spark, tmp_path):
    from foliospark.plans import catalog

    text = "There was strong growth in profit this year. Losses could adversely affect us in many ways."
    rows = [(k, t, y, "2020-03-01", f"a{k}", "1A", text, "web") for k, (t, y) in enumerate([("AB", 2020), (None, 2020), ("AB", None), (None, None)])]
    spark.createDataFrame(rows, "doc_id bigint, ticker string, fiscal_year int, filing_date string, accession string, item string, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("AB", "Acme")], "ticker string, alias string").write.parquet(f"{tmp_path}/alias_map.parquet")
    for query in (catalog.q_section_scores, catalog.q_section_scores_tuned, catalog.q_section_scores_collapsed):
        assert sorted(r["accession"] for r in query(spark, str(tmp_path)).collect()) == ["a0", "a1", "a2", "a3"]
    assert {r["accession"] for r in catalog.q_sentence_scores(spark, str(tmp_path)).collect()} == {"a0", "a1", "a2", "a3"}
    got = catalog.q_prepared_sections(spark, str(tmp_path)).collect()
    assert sorted((r["ticker"] or "", r["fiscal_year"] or 0) for r in got) == [("", 0), ("", 2020), ("AB", 0), ("AB", 2020)]
