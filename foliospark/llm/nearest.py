"""Nearest record in time of the same entity, by joins over expanding rings (problem 2).

Time is cut into buckets. In ring r they are ring0 * 2**r wide, and an instant looks at its own bucket and the two beside it,
which hold everything within one bucket width of it: a match no farther than that width is provably the nearest and is
accepted. What is left goes on to buckets twice as wide, until their width reaches the tolerance.

In ring 0 the own bucket is searched by two running windows over (entity, bucket). After that an instant that is still
unresolved has no record in its own former bucket, so of every bucket only the first and the last instant can be nearest:
the right side of all later rings is two instants for each bucket, taken from those of the ring before. No pairs of a group
are ever made, and a hot entity is spread over its buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions.text import norm_ticker
from foliospark.storage import materialize

SECOND = 1_000_000


def _bucket(at: Column, width: int) -> Column:
    return ((at - F.pmod(at, F.lit(width))) / F.lit(width)).cast("bigint")


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970 as the clock shows it: the session's time zone and its summer time play no part."""
    ntz = ts.cast("timestamp_ntz")
    day = F.datediff(ntz.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * (86400 * SECOND)
    return day + (F.hour(ntz) * 3600 + F.minute(ntz) * 60).cast("bigint") * SECOND + (F.date_part(F.lit("SECOND"), ntz) * SECOND).cast("bigint")


def _key(point: Column, record: Column) -> Column:
    """Twice the distance, and one more for a later record: the least key is the nearest record, of two as near the earlier one."""
    return F.abs(record - point) * 2 + (record > point).cast("bigint")


def _nearer(point: Column, records: list[tuple[Column, Column]]) -> list[Column]:
    """(k, r_id) of the nearest of the records (at, id), null where there is none."""
    keys = [_key(point, at) for at, _ in records]
    best = F.least(*keys) if len(keys) > 1 else keys[0]
    return [best.alias("k"), F.coalesce(*[F.when(k == best, r_id) for k, (_, r_id) in zip(keys, records)]).alias("r_id")]


def _resolve(points: DataFrame, records: DataFrame, tolerance: int, rings: int) -> DataFrame:
    """(entity, at, dist, r_at, r_id) of distinct points (entity, at) and distinct records (entity, at, r_id); times in microseconds.

    Candidates are compared by one number (_key), so that every aggregation is by hash. Rings end where no point is open.
    """
    ring0 = max(1, -(-tolerance // 2**rings))
    records = records.withColumn("bucket", _bucket(F.col("at"), ring0))
    open_points = points.withColumn("bucket", _bucket(F.col("at"), ring0))
    first_last = lambda fa, fi, la, li: [F.min(fa).alias("fa"), F.min_by(fi, fa).alias("fi"), F.max(la).alias("la"), F.max_by(li, la).alias("li")]
    edges0 = materialize(records.groupBy("entity", "bucket").agg(*first_last("at", "r_id", "at", "r_id")), "nearest-edges")

    # Ring 0, the own bucket: the last record at or before the point, and the first after it.
    rec = F.struct("at", "r_id")
    both = open_points.select("entity", "bucket", "at", F.lit(1).alias("side"), F.lit(None).cast("struct<at:bigint,r_id:bigint>").alias("rec")).unionByName(
        records.select("entity", "bucket", "at", F.lit(0).alias("side"), rec.alias("rec"))
    )
    w = W.partitionBy("entity", "bucket")
    both = both.withColumn("before", F.last("rec", True).over(w.orderBy("at", "side"))).withColumn("after", F.last("rec", True).over(w.orderBy(F.desc("at"), F.desc("side"))))
    own = both.where("side = 1").select("entity", "at", *_nearer(F.col("at"), [(F.col(f"{x}.at"), F.col(f"{x}.r_id")) for x in ("before", "after")]))

    found, width = [], ring0
    for ring in range(rings + 1):
        edges = edges0 if ring == 0 else edges0.groupBy("entity", F.shiftright("bucket", ring).alias("bucket")).agg(*first_last("fa", "fi", "la", "li"))
        asked = open_points.select("entity", "at", F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])).alias("bucket"))
        near = asked.join(edges, ["entity", "bucket"], "left").select("entity", "at", *_nearer(F.col("at"), [(F.col("fa"), F.col("fi")), (F.col("la"), F.col("li"))]))
        if ring == 0:
            near = near.unionByName(own)
        best = near.groupBy("entity", "at").agg(F.min("k").alias("k"), F.min_by("r_id", "k").alias("r_id")).withColumn("dist", F.shiftright("k", 1))
        best = materialize(best, f"nearest-ring{ring}")
        r_at = F.when(F.col("k").bitwiseAND(F.lit(1)) == 1, F.col("at") + F.col("dist")).otherwise(F.col("at") - F.col("dist"))
        found.append(best.where(F.col("dist") <= min(width, tolerance)).select("entity", "at", "dist", r_at.alias("r_at"), "r_id"))
        still = best.where(F.col("dist").isNull() | (F.col("dist") > width))
        width *= 2
        open_points = still.select("entity", "at", F.shiftright(_bucket(F.col("at"), ring0), ring + 1).alias("bucket"))
        if ring < rings and open_points.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def nearest_by_time(left: DataFrame, right: DataFrame, *, tolerance_s: int, rings: int = 8) -> DataFrame:
    """(entity, at, id, distance_us) for each distinct (entity, at) of left with a record of right within tolerance_s seconds.

    left has entity and at (date or timestamp), right has entity, at and id (bigint); entities are compared as they are. The
    nearest record wins; of equal distances the earlier instant, of equal instants the least id. The tolerance itself is
    included. Null entities, instants and ids match nothing; repeated rows count once; either side may be empty; other
    columns are not read.
    """
    points = left.select("entity", F.col("at").cast("timestamp_ntz").alias("_ntz"), wall_micros(F.col("at")).alias("at")).where("entity is not null and at is not null").distinct()
    records = right.select("entity", wall_micros(F.col("at")).alias("at"), F.col("id").cast("bigint").alias("r_id")).where("entity is not null and at is not null and r_id is not null")
    records = records.groupBy("entity", "at").agg(F.min("r_id").alias("r_id"))
    best = _resolve(points.select("entity", "at"), records, tolerance_s * SECOND, rings)
    return points.join(best, ["entity", "at"]).select("entity", F.col("_ntz").alias("at"), F.col("r_id").alias("id"), F.col("dist").alias("distance_us"))


def nearest_quotes(returns: DataFrame, quotes: DataFrame, *, date_fields: tuple[str, ...] = ("filing_date", "buy_date"), tolerance_s: int = 36 * 3600, rings: int = 8) -> DataFrame:
    """(return_id, date_field, quote_id): for each return and non-null date the nearest quote of its ticker; a date is its midnight.

    Tickers compare trimmed and in upper case. Rows of either table repeated as a whole count once.
    """
    dates = F.explode(F.array(*[F.struct(F.lit(f).alias("date_field"), wall_micros(F.col(f)).alias("at")) for f in date_fields])).alias("d")
    asked = returns.select("return_id", norm_ticker(F.col("ticker")).alias("entity"), dates).select("return_id", "entity", "d.date_field", "d.at").where("entity is not null and at is not null").distinct()
    records = quotes.select(norm_ticker(F.col("ticker")).alias("entity"), wall_micros(F.col("quoted_at")).alias("at"), F.col("quote_id").cast("bigint").alias("r_id"))
    records = records.where("entity is not null and at is not null and r_id is not null").groupBy("entity", "at").agg(F.min("r_id").alias("r_id"))
    best = _resolve(asked.select("entity", "at").distinct(), records, tolerance_s * SECOND, rings)
    return asked.join(best, ["entity", "at"]).select("return_id", "date_field", F.col("r_id").alias("quote_id"))
