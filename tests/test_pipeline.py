import json

from foliospark.plans import pipeline


def page(*parts):
    return ("<html><body>" + "".join(f"<p>{p}</p>" for p in parts) + "</body></html>").encode()


def test_from_raw_pages_to_scores(spark, tmp_path):
    raw, bronze, out, gold = (str(tmp_path / n) for n in ("raw", "bronze", "silver", "gold"))
    body = lambda y: page(f"FORM 10-K {y}", "Item 1. Business", "We make things. " * 60, "Item 1A. Risk Factors", "Losses could adversely affect us in many ways. " * 40, "Item 7. Results of Operations", "There was strong growth in profit this year. " * 40, "Item 8. Statements", "x")
    for year in (2020, 2021):
        d = tmp_path / "raw" / "AB" / str(year)
        d.mkdir(parents=True)
        (d / f"AB_{year}-03-01_1-{year}.htm").write_bytes(body(year))
        (d / "exhibit.htm").write_bytes(page("nothing"))
    for name, content in (("note.txt", b"no page"),):
        d = tmp_path / "raw" / "CD" / "2020"
        d.mkdir(parents=True)
        (d / name).write_bytes(content)
    least = {"1": 100, "1A": 100, "7": 100, "7A": 100}
    report = pipeline.parse(spark, raw_base=raw, out_base=bronze, report=str(tmp_path / "report"), min_chars=least)
    rows = {(r["ticker"], r["year"]): r for r in report.collect()}
    assert {k: r["status"] for k, r in rows.items()} == {("AB", 2020): "OK", ("AB", 2021): "OK", ("CD", 2020): "NO_HTML"}
    written = spark.read.csv(str(tmp_path / "report"), header=True)
    assert {(r["ticker"], r["status"]) for r in written.collect()} == {("AB", "OK"), ("CD", "NO_HTML")}
    assert spark.read.parquet(bronze).count() == 6
    again = pipeline.parse(spark, raw_base=raw, out_base=bronze, min_chars=least)
    assert {r["status"] for r in again.where("ticker = 'AB'").collect()} == {"SKIP_EXISTS"} and spark.read.parquet(bronze).count() == 6

    data = pipeline.build(spark, report=str(tmp_path / "report"), bronze=bronze, min_years=2, outdir=out)
    assert sorted((r["ticker"], r["year"], r["section"]) for r in data.collect()) == [("AB", y, s) for y in (2020, 2021) for s in ("1A", "7")]
    assert spark.read.text(f"{out}/tickers").head()[0] == "AB"
    assert data.columns == ["section", "text", "text_len", "src", "has_1", "has_1A", "has_7", "has_7A", "ticker", "year"]

    (tmp_path / "aliases.json").write_text(json.dumps({"AB": ["things"]}))
    first = pipeline.score(spark, silver_path=f"{out}/dataset.parquet", outdir=gold, emit_sentences=True, resume=True, aliases=str(tmp_path / "aliases.json"), collapse=True)
    assert first.count() == 4 and {r["label"] for r in first.where("item = '7'").collect()} == {"positive"}
    second = pipeline.score(spark, silver_path=f"{out}/dataset.parquet", outdir=gold, emit_sentences=True, resume=True)
    assert second.count() == 0 and spark.read.parquet(f"{gold}/section_scores").count() == 4
    pages, ranked = pipeline.diagnose(spark, raw_base=raw, ticker="AB", year=2020, all_labels=True)
    assert pages.count() == 2 and {r["label"] for r in ranked.collect()} == {"1", "1A", "7"}


def test_ingest_from_recorded_pages(spark, tmp_path):
    u = lambda n: f"file://{tmp_path}/{n}"
    (tmp_path / "map.json").write_text(json.dumps({"0": {"ticker": "AB", "cik_str": 7}, "1": {"ticker": "ZZ", "cik_str": 8}}))
    recent = {"form": ["10-K", "10-K/A"], "filingDate": ["2021-03-01", "2021-03-02"], "accessionNumber": ["1-2", "1-3"], "primaryDocument": ["a.htm", "b.htm"]}
    (tmp_path / "CIK0000000007.json").write_text(json.dumps({"filings": {"recent": recent, "files": [{"name": "old.json"}]}}))
    (tmp_path / "old.json").write_text(json.dumps({"filings": {"recent": {**{k: [] for k in recent}}}}))
    (tmp_path / "docs/7/12").mkdir(parents=True)
    (tmp_path / "docs/7/12/a.htm").write_bytes(b"<p>report</p>")
    out = pipeline.ingest(spark, tickers="ab,none", map_url=u("map.json"), submissions_url=u("{name}"), documents_url=u("docs"), outdir=str(tmp_path / "raw"), sleep=0)
    assert [(r["ok"], r["path"].rsplit("/", 3)[1:]) for r in out.collect()] == [(True, ["AB", "2021", "AB_2021-03-01_1-2.htm"])]


def test_ingest_reads_days_without_hyphens(spark, tmp_path):
    u = lambda n: f"file://{tmp_path}/{n}"
    (tmp_path / "map.json").write_text(json.dumps({"0": {"ticker": "AB", "cik_str": 7}}))
    recent = {"form": ["10-K"], "filingDate": ["20220201"], "accessionNumber": ["1-2"], "primaryDocument": ["a.htm"]}
    (tmp_path / "CIK0000000007.json").write_text(json.dumps({"filings": {"recent": recent}}))
    (tmp_path / "docs/7/12").mkdir(parents=True)
    (tmp_path / "docs/7/12/a.htm").write_bytes(b"<p>report</p>")
    out = pipeline.ingest(spark, tickers="ab", map_url=u("map.json"), submissions_url=u("{name}"), documents_url=u("docs"), outdir=str(tmp_path / "raw"), sleep=0)
    assert [(r["ok"], r["path"].rsplit("/", 3)[1:]) for r in out.collect()] == [(True, ["AB", "2022", "AB_20220201_1-2.htm"])]


def test_a_later_parse_changes_no_coverage(spark, tmp_path):
    raw, bronze = str(tmp_path / "raw"), str(tmp_path / "bronze")
    for year in (2020, 2021):
        d = tmp_path / "raw" / "AB" / str(year)
        d.mkdir(parents=True)
        (d / f"AB_{year}-03-01_1-{year}.htm").write_bytes(page("FORM 10-K", "Item 1A. Risk Factors", "Losses could adversely affect us. " * 40, "Item 7. Results of Operations", "There was strong growth in profit. " * 40, "Item 8. Statements", "x"))
    least = {"1": 100, "1A": 100, "7": 100, "7A": 100}
    data = []
    for k in range(2):
        pipeline.parse(spark, raw_base=raw, out_base=bronze, report=str(tmp_path / f"report{k}"), min_chars=least, with_dates=True)
        out = pipeline.build(spark, report=str(tmp_path / f"report{k}"), bronze=bronze, min_years=2, outdir=str(tmp_path / f"out{k}"))
        data.append(sorted((r["ticker"], r["year"], r["section"], r["text"]) for r in out.collect()))
    assert data[0] == data[1] and len(data[0]) == 4
    assert {str(r["filing_date"]) for r in spark.read.parquet(bronze).collect()} == {"2020-03-01", "2021-03-01"}


def test_the_model_sees_each_sentence_once(spark, tmp_path):
    rows = spark.createDataFrame([("AB", 2020, "Item 7", "The profit of the year was far over that of the last one. Losses were few and small in all our divisions."), ("AB", 2021, "Item 7", "Nothing at all is to be said about this year.")], "ticker string, year int, section string, text string")
    rows.write.parquet(str(tmp_path / "silver"))
    log = str(tmp_path / "seen")

    def make():
        def scorer(batch):
            with open(log, "a") as f:
                f.writelines(f"{s}\n" for s in batch)
            return [(0.5, 0.25, 0.25)] * len(batch)

        return scorer

    how = {"silver_path": str(tmp_path / "silver"), "outdir": str(tmp_path / "gold"), "emit_sentences": True, "resume": True, "by_model": True, "make_scorer": make}
    assert pipeline.score(spark, model="a", **how).count() == 2
    seen = open(log).read().splitlines()
    assert len(seen) == len(set(seen)) == 3
    assert pipeline.score(spark, model="a", **how).count() == 0 and pipeline.score(spark, model="b", **how).count() == 2
    assert spark.read.parquet(str(tmp_path / "gold/sentence_scores")).count() == 6
