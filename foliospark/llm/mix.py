"""Mixing sources to target weights by Pfair scheduling (problem 7).

How large the mix is and how much each source gives follows from the totals of the sources alone. Each source is then cut into
blocks of equally many tokens; block j of a source with weight w is released at slot floor((j - 1) / w) and due at slot
ceil(j / w), and earliest deadline first fills slot after slot, so every source is always within one block of its share.

A mix of more blocks than the schedule holds runs through it in cycles: every cycle has the same number of blocks of each
source, and as many cycles follow each other as keep a block near its wanted size, so the schedule is of bounded size and a
block is not, however large the mix, more than that.

Documents get their places by prefix sums over the sources in a fixed shuffled order. The sums are taken over hash buckets
first, of which a source has as many as its number of documents asks for, so no source, however large, is sorted in one task.
"""

from __future__ import annotations

import heapq
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions.text import trim_ws
from foliospark.llm.encode import BYTE_BPE_50K, count_tokens
from foliospark.storage import materialize

#: Documents of a source to a bucket, about; tokens to a block; blocks to a cycle of the schedule.
BUCKET_ROWS = 50_000
BLOCK_TOKENS = 4096
MAX_BLOCKS = 20_000
MAX_SOURCES = 10_000


def norm_source(c) -> F.Column:
    return F.lower(trim_ws(c))


def quotas(totals: dict[str, int], targets: dict[str, tuple[float, int]], size: int | None = None) -> dict[str, float]:
    """Tokens that each source gives to a mix of `size` tokens (by default as many as all its documents have together).

    Each source gets its target share, but no more than its documents allow when each is used max_repeats times; what such
    sources lack is filled by the others in proportion to their targets, until the mix is full or nothing is left to repeat.
    """
    room = {s: float(totals.get(s, 0)) * max(0, repeats) for s, (_, repeats) in targets.items()}
    share = {s: max(0.0, float(x)) for s, (x, _) in targets.items()}
    want = float(sum(totals.get(s, 0) for s in targets) if size is None else size)
    out = dict.fromkeys(targets, 0.0)
    open_sources = [s for s in targets if share[s] > 0 and room[s] > 0]
    rest = want
    while open_sources and rest > 1e-9:
        unit = rest / sum(share[s] for s in open_sources)
        full = [s for s in open_sources if share[s] * unit >= room[s] - 1e-9]
        if not full:
            for s in open_sources:
                out[s] = share[s] * unit
            break
        for s in full:
            out[s] = room[s]
            rest -= room[s]
            open_sources.remove(s)
    return out


def pfair(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block from 0) slot by slot: earliest deadline first among the released blocks; ties by name."""
    total = sum(blocks.values())
    later = [(0, s, 1) for s, n in blocks.items() if n]
    heapq.heapify(later)
    ready: list[tuple[int, str, int]] = []
    out: list[tuple[str, int]] = []
    for slot in range(total):
        while later and later[0][0] <= slot:
            _, s, j = heapq.heappop(later)
            heapq.heappush(ready, (-(-j * total // blocks[s]), s, j))
        if not ready:  # cannot be while the weights add up to one; kept so that no block is ever lost
            release, s, j = heapq.heappop(later)
            heapq.heappush(ready, (-(-j * total // blocks[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j - 1))
        if j < blocks[s]:
            heapq.heappush(later, (j * total // blocks[s], s, j + 1))
    return out


def cycle_of(quota: dict[str, float], block_tokens: int = BLOCK_TOKENS, max_blocks: int = MAX_BLOCKS) -> tuple[dict[str, int], int]:
    """(blocks of each source in a cycle, number of cycles): at most max_blocks in a cycle and one more for each source."""
    given = {s: q for s, q in quota.items() if q > 0}
    total = sum(given.values())
    if not total:
        return {}, 0
    cycles = max(1, ceil(total / (block_tokens * max_blocks)))
    slots = min(max_blocks, max(len(given), ceil(total / block_tokens)))
    return {s: max(1, ceil(q / total * slots - 1e-9)) for s, q in given.items()}, cycles


def _plan(docs: DataFrame, targets: DataFrame, text_col: str, tokenizer: str, size: int | None) -> tuple[DataFrame, dict[str, tuple[int, int]], dict[str, tuple[float, int]], dict[str, float]]:
    rows = targets.select(norm_source(F.col("source")).alias("s"), "target_share", "max_repeats").where("s is not null and target_share is not null").groupBy("s").agg(F.sum("target_share"), F.max(F.coalesce("max_repeats", F.lit(1)))).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources with a target")
    wanted = {r[0]: (float(r[1]), int(r[2])) for r in rows}
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), norm_source(F.col("source")).alias("s"), F.col(text_col).alias("text")).where(F.col("s").isin(list(wanted)) & F.col("doc_id").isNotNull())
    counted = materialize(count_tokens(named, "doc_id", "s", text_col="text", tokenizer=tokenizer), "mix-counts")
    totals = {r[0]: (int(r[1]), r[2]) for r in counted.groupBy("s").agg(F.sum("n_tokens"), F.count("*")).collect()}  # at most MAX_SOURCES rows
    return counted, totals, wanted, quotas({s: n for s, (n, _) in totals.items()}, wanted, size)


def mix_sources(docs: DataFrame, targets: DataFrame, *, text_col: str = "text", tokenizer: str = BYTE_BPE_50K, size: int | None = None, block_tokens: int = BLOCK_TOKENS, max_blocks: int = MAX_BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(slot, source, doc_id, copy_no, n_tokens, place): the mix in order of (slot, place); copy_no counts a document's uses from 0.

    docs has doc_id, source and text, targets has source, target_share and max_repeats; sources compare trimmed and in lower
    case. A document is used as many times as whole rounds of its source fit into the source's quota, and once more while
    the round that does not fit is under it, so each source ends within one document of its quota and no document is used
    more often than max_repeats. Sources without a target, and documents of null source or id, are not in the mix; documents
    of no tokens are (they cost nothing). Repeated rows count as documents of their own. Empty tables give no rows.
    """
    spark = docs.sparkSession
    counted, totals, wanted, quota = _plan(docs, targets, text_col, tokenizer, size)
    blocks, cycles = cycle_of(quota, block_tokens, max_blocks)
    order = pfair(blocks)
    schedule = spark.createDataFrame([(s, j, slot) for slot, (s, j) in enumerate(order)], "s string, j bigint, in_cycle bigint")
    rows = [(s, quota[s], totals[s][0], wanted[s][1], ceil(totals[s][1] / bucket_rows), n, quota[s] / (n * cycles)) for s, n in blocks.items()]
    givers = spark.createDataFrame(rows, "s string, quota double, total bigint, most int, buckets bigint, n_blocks bigint, block double")

    # The upper bits of the hash give the bucket, so buckets follow each other in the order of the hash.
    hashed = counted.join(F.broadcast(givers), "s").withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    hashed = hashed.withColumn("b", F.floor((F.shiftright("h", 33) + F.lit(1 << 30)) * F.col("buckets") / F.lit(1 << 31)))
    sums = hashed.groupBy("s", "b").agg(F.sum("n_tokens").alias("t"))
    before = sums.select("s", "b", F.coalesce(F.sum("t").over(W.partitionBy("s").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("t0"))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("s", "b").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = hashed.withColumn("inside", inside).join(before, ["s", "b"]).withColumn("at", F.col("t0") + F.col("inside"))
    # Copy c of a document stands at c * total + at; it is used if its middle is under the quota.
    uses = F.least(F.col("most"), F.greatest(F.lit(0), F.ceil((F.col("quota") - F.col("at") - F.col("n_tokens") / 2) / F.col("total")).cast("int")))
    used = placed.withColumn("uses", uses).where("uses > 0").select("s", "doc_id", "n_tokens", "at", "total", "n_blocks", "block", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("copy_no"))
    used = used.withColumn("pos", F.col("copy_no") * F.col("total") + F.col("at"))
    used = used.withColumn("nth", F.least(F.floor(F.col("pos") / F.col("block")), F.col("n_blocks") * cycles - 1)).withColumn("j", F.col("nth") % F.col("n_blocks"))
    slot = F.floor(F.col("nth") / F.col("n_blocks")) * len(order) + F.col("in_cycle")
    return used.join(F.broadcast(schedule), ["s", "j"]).select(slot.alias("slot"), F.col("s").alias("source"), "doc_id", "copy_no", "n_tokens", F.col("pos").alias("place"))


def _prefix_sums(rows: DataFrame, keys: list[str], value: str, name: str, chunk: int) -> DataFrame:
    """rows with the sum of value over the earlier slots of the same keys: within chunks of slots, and over the sums of chunks."""
    sums = rows.groupBy(*keys, "chunk").agg(F.sum(value).alias("_t"))
    over = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*keys, "chunk", F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_t0"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*keys, "chunk").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_in", inside).join(before, [*keys, "chunk"]).withColumn(name, F.col("_t0") + F.col("_in")).drop("_t0", "_in")


def deviation(mix: DataFrame, *, chunk: int = 10_000) -> DataFrame:
    """(source, reached_share, n_slots, most_off, longest): how far, in tokens, each source ever is from its share of the mix so far.

    Measured before and after each slot of the source, where it is farthest; longest is the source's longest document. Prefix
    sums go by chunks of slots, so that no task sorts the whole mix.
    """
    slots = mix.groupBy("slot", "source").agg(F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("longest")).withColumn("chunk", F.floor(F.col("slot") / chunk))
    slots = slots.withColumn("whole", F.lit(0))
    both = _prefix_sums(_prefix_sums(slots, ["whole"], "t", "all_before", chunk), ["source"], "t", "own_before", chunk)
    totals = mix.groupBy("source").agg(F.sum("n_tokens").alias("own"))
    share = totals.withColumn("share", F.col("own") / F.sum("own").over(W.partitionBy()))
    both = both.join(share.select("source", "share"), "source")
    off = F.greatest(F.abs(F.col("own_before") - F.col("share") * F.col("all_before")), F.abs(F.col("own_before") + F.col("t") - F.col("share") * (F.col("all_before") + F.col("t"))))
    return both.groupBy("source").agg(F.first("share").alias("reached_share"), F.count("*").alias("n_slots"), F.max(off).alias("most_off"), F.max("longest").alias("longest"))


def shares(docs: DataFrame, targets: DataFrame, *, text_col: str = "text", tokenizer: str = BYTE_BPE_50K, size: int | None = None, **how) -> DataFrame:
    """(source, target_share, reached_share, n_tokens, n_docs, n_uses, most_repeats) for each source with a target, used or not.

    how: options of mix_sources.
    """
    mix = mix_sources(docs, targets, text_col=text_col, tokenizer=tokenizer, size=size, **how)
    per_source = mix.groupBy("source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum(F.when(F.col("copy_no") == 0, 1).otherwise(0)).alias("n_docs"), F.count("*").alias("n_uses"), (F.max("copy_no") + 1).alias("most_repeats")
    )
    named = targets.select(norm_source(F.col("source")).alias("source"), "target_share").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    all_tokens = F.sum("n_tokens").over(W.partitionBy())
    joined = named.join(per_source, "source", "left").withColumn("all_tokens", all_tokens)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "source",
        "target_share",
        F.when(F.col("all_tokens") > 0, zero(F.col("n_tokens")) / F.col("all_tokens")).otherwise(F.lit(0.0)).alias("reached_share"),
        zero(F.col("n_tokens")).alias("n_tokens"),
        zero(F.col("n_docs")).alias("n_docs"),
        zero(F.col("n_uses")).alias("n_uses"),
        zero(F.col("most_repeats")).cast("int").alias("most_repeats"),
    )
