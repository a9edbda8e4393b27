"""The registered queries over the test tables, and the SQL to check them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import patterns as P
from foliospark.functions import text as T
from foliospark.operators import analytics, documents, entities, scoring, sections, sentences, silver
from foliospark.plans import oracle
from foliospark.sources import filings as web
from foliospark.streaming.ingest import windowed_counts

#: The test sections are short; the production limits would find few of them long enough.
MIN_CHARS = {"1": 300, "1A": 300, "7": 300, "7A": 200}
HEADS = {"1": "Item 1. Business", "1A": "Item 1A. Risk Factors", "7": "Item 7. Results of Operations", "7A": "Item 7A. Market Risk"}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def filing_texts(spark: SparkSession, d: str) -> DataFrame:
    """(accession, text): the sections of a filing under their headers, as one report."""
    head = F.coalesce(*[F.when(F.col("item") == k, F.lit(v)) for k, v in HEADS.items()])
    docs = _t(spark, d, "documents").where("text is not null and accession is not null")
    parts = docs.groupBy("accession").agg(F.array_sort(F.collect_list(F.struct("item", "doc_id", F.concat(head, F.lit("\n"), F.col("text")).alias("part")))).alias("parts"))
    return parts.select("accession", F.array_join("parts.part", "\n\n").alias("text"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<html><head><style>p { x }</style><script>var a = '<p>';</script></head><body><p>"), F.replace(F.col("text"), F.lit("\n"), F.lit("</p>\n<br/><p>")), F.lit("</p></body></html>"))
    return _t(spark, d, "documents").where("text is not null").select("doc_id", "ticker", "fiscal_year", "source", html.alias("html"))


def q_count(spark, d):
    return analytics.row_count(_t(spark, d, "lineitem"))


def q_peek_topk(spark, d):
    return analytics.peek(_t(spark, d, "orders"), ["o_orderkey", "o_totalprice", "o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"])


def q_label_distribution(spark, d):
    return analytics.label_distribution(_t(spark, d, "finbert_section_scores"))


def q_distinct_sorted(spark, d):
    return analytics.distinct_sorted(_t(spark, d, "finbert_section_scores"), "ticker")


def q_point_lookup(spark, d):
    return analytics.point_lookup(_t(spark, d, "documents"), ["doc_id"], ticker="KPCPQX", item="1A").select("doc_id", "ticker", "item", "n_chars")


def q_form_date_filter(spark, d):
    return web.annual_reports(_t(spark, d, "submissions")).select("ticker", "form", "filing_date", "accession_number")


def q_in_filter(spark, d):
    return _t(spark, d, "documents").where(F.col("item").isin("1A", "7")).select("doc_id", "item")


def _spellings(spark, d):
    """(doc_id, k, raw): the items of documents as they are and in other spellings, and the sources."""
    item = F.col("item")
    raw = F.array(item, F.concat(F.lit("Item "), item, F.lit(".")), F.concat(F.lit(" item-"), F.lower(item)), F.concat(F.lit("ITEM_"), item, F.lit(": Risk")), F.concat(F.lit("ITEM"), item, F.lit(".")), "source")
    return _t(spark, d, "documents").select("doc_id", F.posexplode(raw).alias("k", "raw")).select("doc_id", F.col("k").cast("bigint").alias("k"), "raw")


def q_norm_label(spark, d):
    return _spellings(spark, d).select("doc_id", "k", T.norm_label(F.col("raw")).alias("label"))


def q_norm_item(spark, d):
    return _spellings(spark, d).select("doc_id", "k", T.norm_item(F.col("raw")).alias("item"))


def q_coverage_summary(spark, d):
    return silver.coverage(_t(spark, d, "parse_report"))


def q_covered_tickers(spark, d):
    return silver.covered_tickers(silver.coverage(_t(spark, d, "parse_report")), min_years=3)


def q_longest_per_group(spark, d):
    docs = _t(spark, d, "documents").where("ticker is not null")
    out = silver.longest_per_label(docs.select("ticker", "item", "text", "source", "doc_id"), ["ticker"], order_col="doc_id")
    return out.select("ticker", "key", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"), "src")


def q_compose_sections(spark, d):
    out = silver.compose(_t(spark, d, "documents").where("accession is not null"), ["accession"], order_col="doc_id")
    return out.select("accession", "section", F.col("text_len").cast("bigint").alias("text_len"), F.md5("text").alias("digest"), *[F.col(f"has_{k}").cast("bigint").alias(f"has_{k.lower()}") for k in HEADS])


def q_semi_join(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "finbert_section_scores").select("accession", "item"), ["accession", "item"], "left_semi").select("doc_id")


def q_anti_join_resume(spark, d):
    docs = _t(spark, d, "documents")
    return scoring.unscored(docs, _t(spark, d, "finbert_section_scores"), ["accession", "item"]).select("doc_id")


def q_lookup_left_join(spark, d):
    known = _t(spark, d, "ticker_map").select(T.norm_ticker(F.col("ticker")).alias("t"), T.zero_fill(F.col("cik_str"), 10).alias("cik")).groupBy("t").agg(F.min("cik").alias("cik"))
    subs = _t(spark, d, "submissions").withColumn("t", T.norm_ticker(F.col("ticker")))
    return subs.join(known, "t", "left").select("accession_number", F.coalesce("cik", F.lit("unknown")).alias("cik"))


def q_sentiment_returns_join(spark, d):
    out = analytics.sentiment_returns(_t(spark, d, "finbert_section_scores"), _t(spark, d, "filing_returns"))
    return out.select("ticker", "fiscal_year", "accession", "item", "polarity", "label", "buy_date", "ret_30d", "ret_60d", "ret_90d")


def q_union_by_name(spark, d):
    a = _t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    b = _t(spark, d, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


def q_union_distinct(spark, d):
    return _t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(_t(spark, d, "supplier").select("s_nationkey")).distinct()


def q_except(spark, d):
    t = lambda n: _t(spark, d, n).select(T.norm_ticker(F.col("ticker")).alias("ticker"))
    return t("ticker_map").subtract(t("documents"))


def q_pivot_sections(spark, d):
    return _t(spark, d, "documents").groupBy("accession").pivot("item", list(HEADS)).agg(F.max("n_chars")).select("accession", *[F.col(k).alias(f"n_{k.lower()}") for k in HEADS])


def q_html_strip(spark, d):
    return _pages(spark, d).select("doc_id", F.md5(documents.strip_markup(F.col("html"))).alias("digest"))


def q_html_lines(spark, d):
    return _pages(spark, d).select("doc_id", F.md5(documents.markup_lines(F.col("html"))).alias("digest"))


def q_html_parsed(spark, d):
    """The lines of pages in which every text is escaped: HTML for two of three documents, XML for the others."""
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.concat(F.lit("<html><head><style>p { x }</style><script>var a = 1;</script></head><body><p>"), F.replace(escaped, F.lit("\n"), F.lit("</p>\n<br/><p>")), F.lit("</p></body></html>"))
    page = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<?xml version='1.0' encoding='ascii'?>"), body)).otherwise(body)
    return _t(spark, d, "documents").where("text is not null").select("doc_id", F.md5(documents.document_lines(page)).alias("digest"))


def q_doc_score_top1(spark, d):
    text = documents.strip_markup(F.col("html"))
    pages = _pages(spark, d).select("ticker", "fiscal_year", "doc_id", text.alias("text"), F.octet_length("html").alias("size"), "source")
    pages = pages.select("ticker", "fiscal_year", "doc_id", documents.page_score(F.col("text"), F.col("size"), F.coalesce("source", F.lit("")), short=1000).alias("score"))
    return documents.best_page(pages, ["ticker", "fiscal_year"], tie_col="doc_id").select("ticker", "fiscal_year", "doc_id", "score")


def _exploded_marks(spark, d):
    return sections.with_marks(filing_texts(spark, d)).select("accession", "text", "_index", F.explode("_index.marks").alias("m")).select("accession", "text", "_index", "m.*")


def q_marks(spark, d):
    return _exploded_marks(spark, d).select("accession", F.col("pos").cast("bigint").alias("pos"), "item")


def q_mark_screens(spark, d):
    text, pos = F.col("text"), F.col("pos")
    return _exploded_marks(spark, d).select("accession", pos.cast("bigint").alias("pos"), sections.in_contents(text, pos).alias("toc"), "near", sections.cross_reference(text, pos).alias("cross_ref"), sections.relating(text, pos).alias("relating"))


def q_next_ender(spark, d):
    marks = _exploded_marks(spark, d)
    end = F.coalesce(*[F.when(F.col("item") == k, sections.ender(F.col("text"), F.col("_index"), F.col("pos"), k)) for k in HEADS])
    return marks.where(F.col("item").isin(*HEADS)).select("accession", F.col("pos").cast("bigint").alias("pos"), end.cast("bigint").alias("ends_at"))


def q_candidates(spark, d):
    out = sections.diagnose(filing_texts(spark, d), "accession", top_k=None)
    return out.select("accession", "label", *[F.col(c).cast("bigint").alias(c) for c in ("start", "span_len", "score")])


def q_diagnose(spark, d):
    out = sections.diagnose(filing_texts(spark, d), "accession", top_k=5)
    return out.select("accession", "label", "preview", *[F.col(c).cast("bigint").alias(c) for c in ("n_raw", "n_candidates", "rank", "start", "span_len", "score")])


def q_best_span(spark, d):
    out = sections.extract_sections(filing_texts(spark, d), "accession", min_chars=MIN_CHARS)
    return out.select("accession", "section", *[F.col(c).cast("bigint").alias(c) for c in ("start", "end", "n_candidates", "score")], F.md5("text").alias("digest"))


def q_parse_report(spark, d):
    out = sections.parse_report(filing_texts(spark, d), "accession", min_chars=MIN_CHARS)
    return out.select(*[F.col(f.name) if f.dataType.simpleString() == "string" else F.col(f.name).cast("bigint").alias(f.name) for f in out.schema.fields])


def _sentences(spark, d):
    return _t(spark, d, "documents").select("doc_id", sentences.split_sentences(F.col("text")).alias("s"))


def q_sentence_split(spark, d):
    return _sentences(spark, d).select("doc_id", F.posexplode("s").alias("k", "sentence")).select("doc_id", F.col("k").cast("bigint").alias("k"), "sentence")


def q_fragment_merge(spark, d):
    return _sentences(spark, d).select("doc_id", F.posexplode(sentences.merge_fragments(F.col("s"))).alias("k", "sentence")).select("doc_id", F.col("k").cast("bigint").alias("k"), "sentence")


def q_alias_discovery(spark, d):
    return entities.discover_aliases(_t(spark, d, "documents"), "doc_id", min_count=4)


def _collapsed(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", T.norm_ticker(F.col("ticker")).alias("ticker"), "text")
    return entities.collapse_entities(docs, _t(spark, d, "alias_map"), "doc_id", heuristic_min=4, cap=1)


def q_alias_collapse(spark, d):
    return _collapsed(spark, d).select("doc_id", "text")


def q_brand_density(spark, d):
    """Weights of the sentences of all documents, the word "the" standing for mentions that were collapsed."""
    text = F.regexp_replace("text", r"\b[Tt]he\b", P.PLACEHOLDER)
    rows = _t(spark, d, "documents").select("doc_id", F.posexplode(sentences.split_sentences(text)).alias("k", "sentence"))
    return rows.select("doc_id", F.col("k").cast("bigint").alias("k"), F.round(sentences.brand_weight(F.col("sentence")), 6).alias("weight"))


def _scored(spark, d, **how):
    return scoring.score_sections(_t(spark, d, "documents"), **how)


def _micro(c):
    """In whole millionths, so that no engine's rounding of halves plays a part."""
    return F.floor(F.col(c) * 1e6 + 1e-3).alias(f"{c.removesuffix('_mean')}_micro")


def q_section_scores(spark, d):
    out, _ = _scored(spark, d)
    means = [_micro(c) for c in ("pos_mean", "neu_mean", "neg_mean", "polarity")]
    return out.select("ticker", "fiscal_year", "filing_date", "accession", "item", F.col("n_sentences").cast("bigint").alias("n_sentences"), *means, "label")


def q_section_scores_tuned(spark, d):
    out, _ = _scored(spark, d, temperature=0.85)
    return out.select("accession", "item", *[_micro(c) for c in ("pos_mean", "neu_mean", "neg_mean")], "label")


def q_section_scores_collapsed(spark, d):
    out, _ = _scored(spark, d, aliases=_t(spark, d, "alias_map"), collapse=True, heuristic_min=4, cap=1)
    return out


def q_sentence_scores(spark, d):
    _, out = _scored(spark, d)
    return out.select("accession", "item", F.col("sent_idx").cast("bigint").alias("sent_idx"), "sentence", *[F.round(c, 6).alias(c) for c in ("pos", "neu", "neg")], "label")


def q_gold_weighted(spark, d):
    """Section means made again from the older scorer's sentences, repeated rows once."""
    rows = _t(spark, d, "finbert_sentence_scores").where("pos is not null and neu is not null and neg is not null").select("accession", "item", "sent_idx", "sentence", "pos", "neu", "neg", "weight").distinct()
    same = rows.withColumns({"ticker": F.lit(""), "fiscal_year": F.lit(0), "filing_date": F.lit("")})  # those of the table differ within a section
    out = scoring.aggregate_sections(same, model="older", collapsed=True, threshold=0.25, temperature=None)
    return out.select("accession", "item", F.col("n_sentences").cast("bigint").alias("n"), *[_micro(c) for c in ("pos_mean", "neu_mean", "neg_mean")])


def q_retune_neutral(spark, d):
    gold = _t(spark, d, "finbert_section_scores").where("pos_mean is not null and neu_mean is not null and neg_mean is not null")
    p, u, n = scoring.retune(F.col("pos_mean"), F.col("neu_mean"), F.col("neg_mean"), 0.85)
    return gold.select("accession", "item", F.round(p, 6).alias("p"), F.round(u, 6).alias("u"), F.round(n, 6).alias("n"), scoring.label_of(p, u, n).alias("label"))


def q_json_navigate(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none").alias("none"))


def q_zip_arrays(spark, d):
    subs = _t(spark, d, "submissions").where("ticker is not null").select("ticker", F.struct("accession_number", "form", "filing_date", "primary_document").alias("r")).distinct()
    arrays = subs.groupBy("ticker", "r.accession_number").agg(F.array_sort(F.collect_list("r")).alias("r"))
    rows = web.zip_rows(F.col("r.form"), F.col("r.filing_date"), F.col("r.accession_number"), F.col("r.primary_document"))
    return arrays.select("ticker", F.inline(rows)).select("ticker", "form", "filing_date", "accession_number", "primary_document")


def q_document_urls(spark, d):
    subs = _t(spark, d, "submissions").where("primary_document is not null")
    url = web.document_url("https://example.org/data", F.col("cik_str"), F.col("accession_number"), F.col("primary_document"))
    name = web.raw_name(F.col("ticker"), F.col("filing_date"), F.col("accession_number"), F.col("primary_document"))
    return subs.select("accession_number", url.alias("url"), name.alias("name"))


def q_returns_from_prices(spark, d):
    prices = _t(spark, d, "price_quotes").select(T.norm_ticker(F.col("ticker")).alias("ticker"), F.col("quoted_at").cast("date").alias("day"), F.col("close_px").alias("price"))
    asked = _t(spark, d, "filing_returns").select(T.norm_ticker(F.col("ticker")).alias("ticker"), "filing_date")
    out = analytics.returns_from_prices(asked, prices)
    return out.select("ticker", "filing_date", "buy_date", *[F.round(f"ret_{n}d", 6).alias(f"ret_{n}d") for n in (30, 60, 90)])


def q_windowed_counts(spark, d):
    out = windowed_counts(_t(spark, d, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def q_summarize(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.summarize(F.col("text")).alias("preview"))


def q_safe_name(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.safe_name(F.concat_ws("/", "ticker", "item", "source")).alias("name"))


def q_xml_sniff(spark, d):
    """Pages of seven kinds, whatever marks them standing before, behind or within the whole text."""
    page = F.concat(F.lit("<html><p>"), F.col("text"), F.lit("</p></html>"))
    kinds = [
        F.concat(F.lit("\n <?xml version='1.0'?>"), page), F.concat(page, F.lit("<XBRL >")), F.concat(page, F.lit("<xbrli:context>")), F.concat(page, F.lit("<DOCUMENT n='1' type='XML'>")),
        F.concat(page, F.lit("</document TYPE=\"xml\">")), F.concat(page, F.lit("<DOCUMENT>\n<TYPE>XML <xbrlfoo>")), page,
    ]
    pages = _t(spark, d, "documents").where("text is not null").select("doc_id", F.get(F.array(*kinds), (F.col("doc_id") % len(kinds)).cast("int")).alias("page"))
    return pages.select("doc_id", documents.looks_like_xml(F.col("page")).alias("xml"))


def q_prepared_sections(spark, d):
    """Older score rows brought to canonical names, items normalized, only 1A and 7 with text."""
    rows = _t(spark, d, "documents").select("ticker", F.col("fiscal_year").alias("year"), F.concat(F.lit("Item "), F.col("item"), F.lit(".")).alias("section"), "text")
    out = scoring.prepare(rows)
    return out.select("ticker", "fiscal_year", "item", "filing_date", "accession", F.length("text").cast("bigint").alias("n"))


def q_select_one(spark, d):
    return spark.sql("select 1 as one")


def q_sql_over_views(spark, d):
    analytics.register(spark, "foliospark_sentiment", f"{d}/finbert_section_scores.parquet")
    return spark.sql("select item, label, count(*) as n from foliospark_sentiment where item in ('1A', '7') group by 1, 2 order by item, n desc, label")


QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}
SQL = oracle.SQL
