"""The queries of this subpackage for the entry module, and the SQL to check them by where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm import encode, language, lines, mix, nearest, neardup, sentences, split
from foliospark.storage import materialize, shared_dir


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.split_texts(_t(spark, d, "documents"), with_text=False).where("piece_no = 1").select("doc_id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_texts(_t(spark, d, "documents"))


def p1_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Each text put together again from its pieces, and whether these keep the limit and the overlap."""
    w = W.partitionBy("doc_id").orderBy("piece_no")
    pieces = split.split_texts(_t(spark, d, "documents")).withColumn("cut", F.coalesce(F.lag("end_pos").over(w), F.lit(0))).withColumn("former", F.lag("start_pos").over(w))
    back = F.col("cut") - F.col("start_pos")
    fresh = F.col("text").substr((back + 1).cast("int"), F.length("text"))
    # A piece begins in the last code points of the one before, or with one of its first words if that is shorter.
    near = (F.col("piece_no") == 0) | ((back <= split.OVERLAP) & ((back > split.OVERLAP // 2) | (F.col("start_pos") - F.col("former") <= split.OVERLAP // 5 + 1)))
    rows = pieces.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("piece_no", fresh.alias("t"))))["t"], "").alias("text"), F.max(F.length("text")).alias("longest"), F.every(near).alias("overlaps"))
    return rows.select("doc_id", F.md5("text").alias("digest"), (F.col("longest") <= split.LIMIT).alias("fits"), "overlaps")


def p1_files(spark: SparkSession, d: str) -> DataFrame:
    """The documents written to a few large files in the shared folder, and these split by ranges."""
    path = f"{shared_dir(spark)}/p1-files-{uuid.uuid4().hex}"
    _t(spark, d, "documents").where("text is not null").select("text").write.text(path)
    return split.split_files(spark, path, glob="*.txt")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest.nearest_quotes(_t(spark, d, "filing_returns"), _t(spark, d, "price_quotes"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_boundaries(_t(spark, d, "documents"))


def p3_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(_t(spark, d, "documents"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return sentences.against_older_counts(_t(spark, d, "documents"), _t(spark, d, "finbert_sentence_scores"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(_t(spark, d, "documents"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(_t(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(_t(spark, d, "documents"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_line_report(_t(spark, d, "documents"))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return lines.remove_lines(docs, lines.repeated_lines(docs))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_ids(_t(spark, d, "documents"))


def p6_offsets(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_offsets(_t(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encode.decode(encode.encode_ids(_t(spark, d, "documents")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_sources(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p7_deviation(spark: SparkSession, d: str) -> DataFrame:
    return mix.deviation(materialize(mix.mix_sources(_t(spark, d, "documents"), _t(spark, d, "mix_targets")), "mix"))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return language.languages_of(docs, language.train(_t(spark, d, "lang_samples"), docs))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(_languages(spark, d))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).select("doc_id", "line_no", "language", F.round("confidence", 6).alias("confidence"))


#: White space as in Unicode, for DuckDB's patterns.
WS = r"[\s\x{0B}\x{85}\p{Z}]"

P2_FOUND = f"""
with r as (select distinct return_id, upper(regexp_replace(ticker, '^{WS}+|{WS}+$', '', 'g')) as ticker, filing_date, buy_date from filing_returns),
d as (select return_id, ticker, 'filing_date' as date_field, filing_date::timestamp as at from r union select return_id, ticker, 'buy_date', buy_date::timestamp from r),
q as (select distinct upper(regexp_replace(ticker, '^{WS}+|{WS}+$', '', 'g')) as ticker, quoted_at, quote_id from price_quotes),
m as (select d.*, q.quote_id, row_number() over (partition by d.return_id, d.date_field, d.ticker, d.at order by abs(epoch_us(q.quoted_at) - epoch_us(d.at)), q.quoted_at, q.quote_id) as rn
      from d join q on d.ticker = q.ticker and abs(epoch_us(q.quoted_at) - epoch_us(d.at)) <= 129600000000)
select return_id, date_field, quote_id from m where rn = 1
"""

_P4 = f"""
with w as (select doc_id, list_filter(string_split_regex(lower(text), '{WS}+'), lambda x: x <> '') as w from documents where text is not null),
s as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as run from w where len(w) >= 30),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as doc_id_a, b.doc_id as doc_id_b, count(*) as c from s a join s b on a.run = b.run and a.doc_id < b.doc_id group by 1, 2),
p as (select doc_id_a, doc_id_b from c join n x on x.doc_id = doc_id_a join n y on y.doc_id = doc_id_b where c.c >= 0.6 * (x.n + y.n - c.c) - 1e-9)
"""

_P5_LINES = f"""
with l as (select doc_id, upper(regexp_replace(ticker, '^{WS}+|{WS}+$', '', 'g')) as ticker, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents where ticker is not null),
f as (select doc_id, ticker, line_no, raw, regexp_replace(trim(regexp_replace(lower(raw), '{WS}+', ' ', 'g'), ' '), '[0-9]+', '#', 'g') as line from l),
k as (select ticker, line, count(distinct doc_id) as n_docs, count(distinct raw) as n_variants from f where length(line) >= 30 group by 1, 2 having count(distinct doc_id) >= 6)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_rebuilt": p1_rebuilt,
    "p1_files": p1_files,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_sentences": p3_sentences,
    "p3_counts": p3_counts,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p5_clean": p5_clean,
    "p6_ids": p6_ids,
    "p6_offsets": p6_offsets,
    "p6_decoded": p6_decoded,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_deviation": p7_deviation,
    "p8_found": p8_found,
    "p8_languages": p8_languages,
}

SQL = {
    "p1_found": "select doc_id from documents where length(text) > 4000",
    "p1_rebuilt": "select doc_id, md5(text) as digest, true as fits, true as overlaps from documents where text is not null",
    "p2_found": P2_FOUND,
    "p4_found": _P4 + "select doc_id_a, doc_id_b from p",
    "p5_found": _P5_LINES + "select doc_id, line_no::int as line_no from f join k using (ticker, line)",
    "p5_report": _P5_LINES + "select ticker, line, n_docs::bigint as n_docs, n_variants::bigint as n_variants from k",
    "p5_clean": _P5_LINES
    + """, x as (select doc_id, line_no, raw, k.line is not null as hit from f left join k using (ticker, line)),
a as (select doc_id, count(*) filter (hit) as n, string_agg(raw, chr(10) order by line_no) filter (not hit) as kept from x group by doc_id)
select documents.doc_id, coalesce(a.n, 0)::int as n_removed, case when coalesce(a.n, 0) = 0 then text else coalesce(kept, '') end as text from documents left join a using (doc_id)""",
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
