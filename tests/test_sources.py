import json

from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.operators import documents as D
from foliospark.sources import files, filings
from foliospark.streaming.ingest import append_stream, windowed_counts


def test_pages_are_found_decoded_and_scored(spark, tmp_path):
    for ticker, year, name, body in [("AB", 2020, "main.htm", b"<p>FORM 10-K</p> Item 1 Item 7A caf\xc3\xa9 \xff!"), ("AB", 2020, "index.HTML", b"<p>nothing</p>"), ("AB", "x", "a.htm", b"?"), ("CD", 2021, "a.html", b"x"), ("CD", 2021, "a.txt", b"x")]:
        p = tmp_path / ticker / str(year)
        p.mkdir(parents=True, exist_ok=True)
        (p / name).write_bytes(body)
    pages = files.read_pages(spark, str(tmp_path))
    assert sorted((r["ticker"], r["year"], r["name"]) for r in pages.collect()) == [("AB", 2020, "index.HTML"), ("AB", 2020, "main.htm"), ("CD", 2021, "a.html")]
    assert files.read_pages(spark, str(tmp_path), tickers=["CD"], years=[2021, 2021]).count() == 1
    scored = pages.withColumn("plain", D.plain_text(F.col("text"))).withColumn("score", D.page_score(F.col("plain"), F.col("size"), F.col("name")))
    best = {r["ticker"]: r for r in D.best_page(scored, ["ticker", "year"]).collect()}
    assert best["AB"]["name"] == "main.htm" and best["AB"]["plain"] == "FORM 10-K Item 1 Item 7A café !"
    # form 10000, headers Item 1, 7 (not 7A) and 7A: two hits of 1500, short text -5000
    assert best["AB"]["score"] == 10000 + 2 * 1500 - 5000


def test_markup(spark):
    html = "<html><script>x<y</script><style>p</style><p>A&amp;B</p>one<br>two<noscript>no</noscript>\r\n\r\n\r\n\r\n<b>Item</b>\t 1A</html>"
    row = spark.createDataFrame([(html,), (None,)], "h string").select(D.strip_markup(F.col("h")).alias("s"), D.document_lines(F.col("h")).alias("l"), D.markup_lines(F.col("h")).alias("m"), D.looks_like_xml(F.lit("  <?xml version='1.0'?>")).alias("x")).collect()
    assert row[0]["s"] == "A&amp;B one two no Item 1A" and row[0]["x"] is True
    assert row[0]["l"] == "A&B\none\n\ntwo\n\nItem\n1A" and row[0]["m"].startswith("A&amp;B\none\ntwo")
    assert row[1]["s"] is None and row[1]["l"] is None


def test_lists_aliases_and_reports(spark, tmp_path):
    (tmp_path / "t.txt").write_text("ab\n# no\n\n cd \n")
    assert [r[0] for r in files.read_tickers(spark, path=str(tmp_path / "t.txt")).collect()] == ["AB", "CD"]
    assert [r[0] for r in files.read_tickers(spark, listed="x, y,,").collect()] == ["X", "Y"]
    (tmp_path / "a.json").write_text(json.dumps({"T": ["One", "Two"], "U": []}))
    (tmp_path / "a.csv").write_text('ticker,alias\nT,"One, Inc."\n')
    assert sorted(r["alias"] for r in files.read_aliases(spark, str(tmp_path / "a.json")).collect()) == ["One", "Two"]
    assert [r["alias"] for r in files.read_aliases(spark, str(tmp_path / "a.csv")).collect()] == ["One, Inc."]
    assert files.read_aliases(spark, None).count() == 0
    report = spark.createDataFrame([("A", 2020, "OK", "line one\nline, two")], "ticker string, year int, status string, details string")
    for f in schemas.REPORT.fields[4:]:
        report = report.withColumn(f.name, F.lit(None).cast(f.dataType))
    files.write_csv(report, str(tmp_path / "r"))
    back = files.read_report(spark, str(tmp_path / "r")).head()
    assert back["details"] == "line one\nline, two" and back["item_1"] is None


def test_sinks_add_only_what_is_new(spark, tmp_path):
    rows = spark.createDataFrame([("A", 2020, 1), ("B", 2020, 2)], "ticker string, year int, v int")
    path = str(tmp_path / "parts")
    files.write_new_partitions(rows, path)
    files.write_new_partitions(rows.withColumn("v", F.col("v") + 10).union(spark.createDataFrame([("C", 2021, 3)], rows.schema)), path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    files.write_new_partitions(rows.where("ticker = 'A'").withColumn("v", F.lit(9)), path, overwrite=True)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [2, 3, 9]
    gold = str(tmp_path / "gold")
    files.append_new(rows, gold, ["ticker", "year"])
    files.append_new(rows, gold, ["ticker", "year"])
    assert spark.read.parquet(gold).count() == 2
    files.write_both(rows, str(tmp_path / "both"))
    assert spark.read.csv(str(tmp_path / "both.csv"), header=True).count() == 2
    files.write_lines(rows, "ticker", str(tmp_path / "lines"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["A", "B"]
    assert files.read_tables(spark, gold).count() == 2


def test_recorded_submissions(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"0": {"ticker": "ab", "cik_str": 123}}))
    main = {"filings": {"recent": {"form": ["10-K", "8-K"], "filingDate": ["2021-03-01", "2021-04-01"], "accessionNumber": ["1-2", "1-3"], "primaryDocument": ["a.htm"]}, "files": [{"name": "old.json"}]}}
    flat = {"form": ["10-K"], "filingDate": ["2019-12-31"], "accessionNumber": ["1-1"], "primaryDocument": ["o"]}
    (tmp_path / "main.json").write_text(json.dumps(main))
    (tmp_path / "old.json").write_text(json.dumps(flat))
    url = lambda n: f"file://{tmp_path}/{n}"
    assert filings.ticker_map(filings.read_json_pages(spark, [url("map.json")])).head()[:] == ("AB", "0000000123")
    pages = filings.read_json_pages(spark, [url("main.json"), url("old.json"), url("none.json")])
    assert [r["name"] for r in filings.older_pages(pages).collect()] == ["old.json"]
    rows = filings.submission_rows(pages)
    assert sorted(r["accession_number"] for r in rows.collect()) == ["1-1", "1-2"]  # cut to the shortest array
    assert [r["accession_number"] for r in filings.annual_reports(rows).collect()] == ["1-2"]
    made = rows.where("accession_number = '1-1'").select(filings.document_url("https://x.example/d/", F.lit("0000000123"), F.col("accession_number"), F.col("primary_document")), filings.raw_name(F.lit("A/B"), F.col("filing_date"), F.col("accession_number"), F.col("primary_document"))).head()
    assert made[0] == "https://x.example/d/123/11/o" and made[1] == "A_B_2019-12-31_1-1.html"
    assert files.real_filing_date(F.lit("x")) is not None
    asked = spark.createDataFrame([(url("map.json"), "AB", 2021, "m.json"), (url("gone"), "AB", 2021, "g.html")], "url string, ticker string, year int, name string")
    out = tmp_path / "raw"
    assert sorted(r["ok"] for r in filings.download(asked, str(out)).collect()) == [False, True]
    assert (out / "AB/2021/m.json").stat().st_size and (out / "AB/2021/ERROR_g.html.txt").exists()


def test_annual_reports_read_both_date_formats(spark):
    days = ["2022-02-01", "20220201", "2019-12-31", "20191231", "20200101", "20241231", "20250101", "20221301", "x", "", None]
    rows = spark.createDataFrame([("10-K", d, str(k)) for k, d in enumerate(days)] + [("8-K", "20220201", "f")], "form string, filing_date string, accession_number string")
    assert sorted(r["accession_number"] for r in filings.annual_reports(rows).collect()) == ["0", "1", "4", "5"]


def test_zipped_arrays_keep_every_submission(spark, tmp_path):
    from foliospark.plans import catalog

    rows = [("AB", "1-1", "10-K", "2020-03-01", "a.htm"), ("AB", "1-1", "10-K", "2020-03-01", "a.htm"), ("AB", "1-1", "10-K/A", "20200302", None), ("AB", "1-2", None, None, "b.htm"), ("AB", None, "8-K", "2021-01-01", "c.htm"), ("CD", "2-1", "10-K", "2020-03-01", "d.htm")]
    names = ["ticker", "accession_number", "form", "filing_date", "primary_document"]
    spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).write.parquet(f"{tmp_path}/submissions.parquet")
    got = [tuple(r[n] for n in names) for r in catalog.q_zip_arrays(spark, str(tmp_path)).collect()]
    assert len(got) == 5 and set(got) == set(rows)


def test_streams_append_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    source, target, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows.write.parquet(source)
    for _ in range(2):
        append_stream(spark, source, rows.schema, lambda df: df, target, ck, ["k"]).awaitTermination()
    rows.union(spark.createDataFrame([(3, "c")], rows.schema)).write.mode("append").parquet(source)
    append_stream(spark, source, rows.schema, lambda df: df, target, ck, ["k"]).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_windows(spark):
    import datetime as dt

    ev = spark.createDataFrame([(dt.datetime(2020, 1, 1, 0, m), "x", 1.5) for m in (5, 50, 65 - 60)], "ts timestamp, event_type string, value double")
    row = windowed_counts(ev).collect()
    assert len(row) == 1 and row[0]["n"] == 3 and row[0]["total"] == 4.5


def test_xml_is_found_anywhere_and_parsed_as_such(spark):
    late = "x" * 5000
    cases = [(f"{late}<xbrl >", True), ("<DOCUMENT type='XML'>", True), ("<DOCUMENT>\n<TYPE>XML", False), ("<xbrlfoo>", False), (f"{late}<xbrli:a>", True), ("\n <?xml version='1.0'?>", True), (f"{late}<?xml", False), ("", False), (None, None)]
    got = spark.createDataFrame(list(enumerate(c[0] for c in cases)), "k int, p string").select("k", D.looks_like_xml(F.col("p")).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in got] == [c[1] for c in cases]
    pages = ["<?xml version='1.0' encoding='utf-16'?><a><script>x</script><p>A&amp;B</p><![CDATA[1 < 2]]><br/>é</a>", "<?xml version='1.0'?><a><p>broken &nbsp; <b>page</a>", "<p>plain <![CDATA[gone]]></p>", None, ""]
    lines = [r[0] for r in spark.createDataFrame(list(enumerate(pages)), "k int, p string").orderBy("k").select(D.document_lines(F.col("p"))).collect()]
    assert lines[0] == "A&B\n1 < 2\n\né" and "broken" in lines[1] and "page" in lines[1] and lines[2].startswith("plain") and lines[3] is None and lines[4] == ""
    assert D._guarded(5, False)[0] is None and "TypeError" in D._guarded(5, True)[1]


def test_bytes_that_are_no_text_go_and_the_replacement_sign_stays(spark):
    raw = "a�".encode() + b"\xff\xfe" + "é".encode()[:1] + b"b"
    assert spark.createDataFrame([(raw,)], "c binary").select(D.decode_page(F.col("c"))).head()[0] == "a�b"


def test_appended_keys_are_single_and_null_safe(spark, tmp_path):
    rows = spark.createDataFrame([("A", None, 1), ("A", None, 2), (None, 3, 4)], "ticker string, year int, v int")
    path = str(tmp_path / "t")
    for _ in range(2):
        files.append_new(rows, path, ["ticker", "year"])
    assert spark.read.parquet(path).count() == 2


def test_tables_of_the_catalog_and_failing_queries(spark, tmp_path):
    from foliospark.operators import analytics

    spark.range(3).write.parquet(str(tmp_path / "t"))
    for _ in range(2):
        assert analytics.register(spark, "folio_kept", str(tmp_path / "t"), persistent=True).count() == 3
    assert spark.catalog.tableExists("folio_kept") and analytics.try_sql(spark, "select count(*) as n from folio_kept")[0].head()["n"] == 3
    df, error = analytics.try_sql(spark, "select * from nowhere_at_all")
    assert df is None and "nowhere_at_all" in error
    spark.sql("drop table folio_kept")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
