"""Near-duplicate documents by pigeonring filtering (problem 4).

A document is the set of its distinct runs of consecutive words. Two sets with a Jaccard similarity of t or more differ in at
most b * (|A| + |B|) runs, b = (1 - t) / (1 + t): a Hamming threshold in proportion to their sizes. The universe of runs is cut
into a ring of segments by hash. If the whole differences stay within the whole budget, there is a segment from which, going
round the ring, the differences of every chain of consecutive segments stay within as many shares of the budget (the
cycle lemma behind the pigeonring principle). This gives, without loss:

1. Candidates. Among the first n - ceil(t * n) + c runs of either set, in one common order with the rare ones first, a pair
   shares c runs, and from each of them on either set is long enough for what must still come. Only these are indexed, and
   pairs that share fewer are none. The order comes from a frequency sketch of fixed size; a rough one costs time, never
   pairs. (Taking the first runs of every segment by itself, as the ring would allow, indexes the runs of boilerplate
   wherever they crowd a segment; over the whole set they come last.)
2. Chains. Each set has a sketch: for each segment a bitmap of its hashed runs, in length proportional to the set. The bits in
   which two bitmaps differ are never more than the runs. A candidate without a chain round the ring, of which every part of
   l segments differs in at most l / m of the budget, is dropped.
3. Full check. The rest is compared run by run.

Documents with equal sets are one class throughout; classes, not documents, are indexed, so copies never meet each other. A
run that more than HOT classes have in their index is no group of its own: its classes go to cells by size and salt, each
cell compares blocks of bounded size by their sketches and gives on only pairs that pass. Runs that the frequency sketch
already shows as very common are not even shuffled by run.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import log, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm._arrow import small_batches
from foliospark.storage import discard, materialize

SEGMENTS = 8
FREQUENCY_BITS = 24
#: Slots for each document that is asked for, and the most of them as a power of two (32 MB).
MEMBER_SLOTS, MEMBER_BITS = 16, 28
HOT = 2000
#: Runs that a pair must share among the indexed ones (fewer only where it need not share as many at all).
AGREE = 3
#: A run this far over the mean level, and over the level of HOT, is known to be hot before it is shuffled: 40 are 32 times as many.
HOT_OVER_MEAN = 40
#: Pairs of a partition that are held at once, about.
PAIRS_AT_ONCE = 4_000_000
BLOCK = 2000
TOKENS_A_PART = 2_000_000
EXPAND_UP_TO = 1000
CHUNK = 1 << 14
_M40 = np.uint64((1 << 40) - 1)


class _Words(dict):
    """Hashes of words, kept while the worker reads; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def runs_of(text: str | None, words: int, min_words: int) -> np.ndarray | None:
    """The distinct 64-bit hashes of the runs of words in text, sorted; None if it has fewer than min_words words."""
    tokens = text.lower().split() if text else []
    if len(tokens) < max(min_words, words):
        return None
    w = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))
    n = len(w) - words + 1
    h = w[:n].copy()
    for k in range(1, words):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w[k : k + n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _class_of(runs: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(runs.tobytes())).astype(np.int64))


def _segment(runs: np.ndarray) -> np.ndarray:
    return (runs >> np.uint64(61)).astype(np.int64) % SEGMENTS


def sketch_of(runs: np.ndarray) -> bytes:
    """A bitmap for each segment, of a power of two of bits: 64, or more so that a segment has 1.5 bits for each run it should have."""
    bits = 64
    while bits * SEGMENTS < 1.5 * len(runs):
        bits *= 2
    out = np.zeros(SEGMENTS * bits, np.uint8)
    out[_segment(runs) * bits + ((runs >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _bitmaps(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of one length as (sketches, segments, words), folded to `width` bytes."""
    raw = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), SEGMENTS, -1)
    while raw.shape[2] * SEGMENTS > width:
        half = raw.shape[2] // 2
        raw = raw[:, :, :half] | raw[:, :, half:]
    return np.ascontiguousarray(raw).view(np.uint64)


def chains(diff: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """For rows of segment differences and the budget of one segment: whether a chain goes round the ring within budget."""
    over = diff - budget[:, None]
    alive = np.ones(over.shape, dtype=bool)
    total = np.zeros(over.shape)
    for step in range(over.shape[1]):
        total += np.roll(over, -step, axis=1)
        alive &= total <= 1e-6
        if not alive.any():
            break
    return alive.any(axis=1)


def ring_filter(sketch_a: list[bytes], size_a: np.ndarray, sketch_b: list[bytes], size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sketches may belong to sets of the threshold."""
    keep = np.zeros(len(sketch_a), dtype=bool)
    widths = np.array([(len(x), len(y)) for x, y in zip(sketch_a, sketch_b)]).reshape(-1, 2)
    share = (1 - threshold) / (1 + threshold) / SEGMENTS
    for wa, wb in np.unique(widths, axis=0):
        at = np.flatnonzero((widths[:, 0] == wa) & (widths[:, 1] == wb))
        a, b = (_bitmaps([s[k] for k in at], min(wa, wb)) for s in (sketch_a, sketch_b))
        keep[at] = chains(np.bitwise_count(a ^ b).sum(axis=2, dtype=np.int64), share * (size_a[at] + size_b[at]))
    return keep


def _need(n: int, t: float) -> int:
    """The least number of runs that a set of n shares with a partner."""
    return int(np.ceil(t * n - 1e-9))


def indexed_runs(runs: np.ndarray, level: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs, levels, places) to index: the first of the set in the common order, as many as the threshold asks for.

    places are those in the order as 255ths of the set, rounded down.
    """
    lv = level[(runs & np.uint64((1 << FREQUENCY_BITS) - 1)).astype(np.int64)]
    order = np.lexsort((runs, lv))[: len(runs) - _need(len(runs), threshold) + AGREE]
    return runs[order], lv[order], (np.arange(len(order)) * 255 // len(runs)).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(raw: bytes, width: int) -> np.ndarray:
    few = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(few), 8), np.uint8)
    out[:, :width] = few
    return out.view("<u8").ravel()


def group_pairs(tokens: np.ndarray, classes: np.ndarray, sizes: np.ndarray, places: np.ndarray, threshold: float, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class a, class b, tokens they share, positions of hot rows): pairs a < b of different classes.

    Their sizes must be near enough, and from the token on either set must have as many runs left as the pair must share, but
    for the AGREE - 1 that may have come before. Pairs that need not share AGREE runs count as if they did. Tokens of more than
    `hot` classes give no pairs; their rows are named instead.
    """
    e = np.zeros(0, np.int64)
    if not len(tokens):
        return e, e, e, e
    order = np.lexsort((classes, tokens))
    t, c = tokens[order], classes[order]
    fresh = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])
    order = order[fresh]
    order = order[np.lexsort((sizes[order], tokens[order]))]
    t, c, s = tokens[order], classes[order], sizes[order].astype(np.float64)
    left = s - np.floor(places[order] * s / 255)
    new = np.concatenate([[True], t[1:] != t[:-1]])
    group = np.cumsum(new) - 1
    count = np.bincount(group)
    is_hot = count[group] > hot
    hot_rows = order[is_hot]
    keep = ~is_hot & (count[group] > 1)
    t, c, s, left = t[keep], c[keep], s[keep], left[keep]
    share = threshold / (1 + threshold)
    out_a, out_b, out_n = [], [], []
    at = np.arange(len(t))
    d = 1
    while True:
        at = at[at + d < len(t)]
        at = at[(t[at] == t[at + d]) & (s[at] >= threshold * s[at + d] - 1e-9)]  # sizes ascend: once too far, always too far
        if not len(at):
            break
        must = share * (s[at] + s[at + d]) - 1e-6
        ok = np.minimum(left[at], left[at + d]) >= must - (AGREE - 1)
        near, must = at[ok], must[ok]
        x, y = c[near], c[near + d]
        out_n.append(np.where(np.ceil(must) < AGREE, AGREE, 1))
        out_a.append(np.minimum(x, y))
        out_b.append(np.maximum(x, y))
        d += 1
    if not out_a:
        return e, e, e, hot_rows
    pa_, pb, n = np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_n)
    order = np.lexsort((pb, pa_))
    pa_, pb, n = pa_[order], pb[order], n[order]
    if not len(pa_):
        return e, e, e, hot_rows
    first = np.flatnonzero(np.concatenate([[True], (pa_[1:] != pa_[:-1]) | (pb[1:] != pb[:-1])]))
    return pa_[first], pb[first], np.add.reduceat(n, first), hot_rows


def token_slices(tokens: np.ndarray, most_pairs: int) -> Iterator[np.ndarray]:
    """Places of the tokens in slices, equal ones together, each slice with about most_pairs pairs of equal ones at most.

    A single token with more pairs stands alone.
    """
    if not len(tokens):
        return
    order = np.argsort(tokens, kind="stable")
    t = tokens[order]
    starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(t)]]))
    block = np.cumsum(counts * (counts - 1) // 2) // most_pairs
    cuts = starts[np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))]
    for x, y in zip(cuts, [*cuts[1:], len(t)]):
        yield order[x:y]


def _flags(rows: DataFrame, width: int) -> np.ndarray:
    """Numbers (bucket) below width as bits, packed to bytes; what comes to the driver is width / 8 bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.asarray(batch.column(0), dtype=np.int64)
            for part in np.unique(at // (8 * CHUNK)):
                bits = held.setdefault(int(part), np.zeros(8 * CHUNK, np.uint8))
                bits[at[at // (8 * CHUNK) == part] % (8 * CHUNK)] = 1
        for part, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bytes"])

    spread = rows.select("bucket").repartition(F.expr(f"bucket div {8 * CHUNK}"))
    return _assembled(spread.mapInArrow(pack, "part int, bytes binary"), max(width // 8, CHUNK))


def _levels(rows: DataFrame) -> tuple[np.ndarray, int]:
    """From compressed chunks of counts (bucket, sketch) the level of every bucket, and that of the mean count.

    A level is eight times the logarithm of one more than a count. Chunks are added up as they come in, so a worker holds one
    sum for each of its buckets, however many tasks have sent some.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(raw.as_py()), np.uint8)
                if bucket not in total:
                    total[bucket] = np.zeros(CHUNK, np.int64)
                total[bucket] += part
        for bucket, counts in total.items():
            level = np.minimum(255, np.round(8 * np.log2(1 + counts))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["part", "bytes"])

    levels = _assembled(rows.select("bucket", "sketch").repartition("bucket").mapInArrow(add, "part int, bytes binary"), 1 << FREQUENCY_BITS)
    mean = (np.exp2(levels / 8.0) - 1).mean()
    return levels, int(round(8 * np.log2(1 + mean)))


def _assembled(chunks: DataFrame, width: int) -> np.ndarray:
    out = np.zeros(width, np.uint8)
    for part, raw in chunks.collect():
        out[part * CHUNK : (part + 1) * CHUNK] = np.frombuffer(bytes(raw), np.uint8)
    return out


def _read_classes(src: DataFrame, words: int, min_words: int) -> DataFrame:
    """kind 0: (doc_id, cls, size, sketch) of each document that is long enough; kind 1: counts of runs by hash.

    Each task counts into an array of fixed size and gives it in compressed chunks, no count over 255.
    """
    schema = "kind tinyint, doc_id bigint, cls bigint, size int, sketch binary, bucket int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << FREQUENCY_BITS, np.uint16)
        kinds = [pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
        names = ["kind", "doc_id", "cls", "size", "sketch", "bucket"]
        mask = np.uint64((1 << FREQUENCY_BITS) - 1)
        for batch in small_batches(batches, "text"):
            ids, cls, sizes, sketches, all_runs = [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs = runs_of(t, words, min_words)
                if runs is None:
                    continue
                ids.append(i)
                cls.append(_class_of(runs))
                sizes.append(len(runs))
                sketches.append(sketch_of(runs))
                all_runs.append(runs)
            if ids:
                np.add.at(seen, (np.concatenate(all_runs) & mask).astype(np.int64), np.uint16(1))
                np.minimum(seen, 30_000, out=seen)
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(ids, kinds[1]), pa.array(cls, kinds[2]), pa.array(sizes, kinds[3]), pa.array(sketches, kinds[4]), pa.nulls(n, kinds[5])], names=names)
        for k in range(0, len(seen), CHUNK):
            part = np.minimum(seen[k : k + CHUNK], 255).astype(np.uint8)
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([1], kinds[0]), *(pa.nulls(1, x) for x in kinds[1:4]), pa.array([zlib.compress(part.tobytes(), 1)], kinds[4]), pa.array([k // CHUNK], kinds[5])], names=names)

    return src.mapInArrow(run, schema)


def _hot_pairs(hot: DataFrame, sketches: DataFrame, threshold: float, block: int) -> DataFrame:
    """Pairs of hot tokens: rows (token, cls, size, rest) go to cells of two blocks of near sizes, compared there by their sketches.

    rest is the number of runs from the token on: as for other tokens, both must have as many left as the pair must still
    share. One hot token in common is enough here: a pair with fewer than AGREE others would not be found by those.
    """
    step = -log(threshold)
    hot = hot.groupBy("token", "cls", "size").agg(F.max("rest").alias("rest")).withColumn("c", F.floor(F.log("size") / F.lit(step)).cast("int"))
    counts = hot.groupBy("token", "c").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("salts"))
    hot = hot.join(counts, ["token", "c"]).withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int"))
    near = counts.select("token", F.col("c").alias("c2"), F.col("salts").alias("salts2"))
    asks = hot.select("token", "cls", "rest", "c", "salt", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c2"))
    asks = asks.join(near, ["token", "c2"]).select("token", "cls", "rest", "c", "salt", "c2", F.explode(F.sequence(F.lit(0), F.col("salts2") - 1)).alias("salt2"))
    mine, other = F.struct("c", "salt"), F.struct(F.col("c2").alias("c"), F.col("salt2").alias("salt"))
    cells = asks.select("cls", "rest", F.xxhash64("token", F.least(mine, other), F.greatest(mine, other)).alias("cell"), (mine <= other).alias("left"), (mine >= other).alias("right"))
    cells = cells.join(sketches, "cls").select("cell", "cls", "rest", "left", "right", "size", "sketch")

    def compare(table):
        cls, sizes, raw = np.asarray(table["cls"]), np.asarray(table["size"]).astype(np.float64), table["sketch"].to_pylist()
        rest, need = np.asarray(table["rest"]), threshold / (1 + threshold)
        widths = np.array([len(x) for x in raw])
        is_left, is_right = np.asarray(table["left"]), np.asarray(table["right"])
        share = (1 - threshold) / (1 + threshold) / SEGMENTS
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for wa in np.unique(widths):
            for wb in np.unique(widths):
                left, right = np.flatnonzero(is_left & (widths == wa)), np.flatnonzero(is_right & (widths == wb))
                if not len(left) or not len(right) or max(wa, wb) * threshold > 2 * min(wa, wb):
                    continue  # no sizes of these lengths are near enough
                folded = _bitmaps([raw[j] for j in right], min(wa, wb))
                for k, bits in zip(left, _bitmaps([raw[j] for j in left], min(wa, wb))):
                    ok = np.flatnonzero((np.minimum(sizes[right], sizes[k]) >= threshold * np.maximum(sizes[right], sizes[k]) - 1e-9) & (cls[right] != cls[k]) & (np.minimum(rest[right], rest[k]) >= need * (sizes[right] + sizes[k]) - (AGREE - 1) - 1e-6))
                    diff = np.bitwise_count(folded[ok] ^ bits).sum(axis=2, dtype=np.int64)
                    ok = right[ok[chains(diff, share * (sizes[right[ok]] + sizes[k]))]]
                    a.append(np.minimum(cls[k], cls[ok]))
                    b.append(np.maximum(cls[k], cls[ok]))
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return cells.groupBy("cell").applyInArrow(compare, "a bigint, b bigint")


def similar_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, threshold: float = 0.6, min_words: int = 30, hot: int = HOT, hot_level: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members (cls, doc_id), links (a, b) with a < b): classes of equal run sets, and all pairs of classes at or over threshold.

    Words stand between white space in the lower-cased text. Null ids and texts, and texts under min_words words, are in no
    class; ids may repeat; an empty table gives empty results; other columns are not read. hot_level: the level from which a
    run is taken for hot before it is shuffled; by default it follows the mean count of the sketch, so it is a property of the
    run and not of the size of the table. Runs that more than hot classes index are found by exact count in any case.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    read = materialize(_read_classes(src, words, min_words), "neardup-classes")
    documents = read.where("kind = 0")
    members = documents.select("cls", "doc_id").distinct()
    sketches = documents.groupBy("cls").agg(F.min(F.struct("doc_id", "size", "sketch")).alias("s")).select("cls", "s.size", "s.sketch")
    levels, mean_level = _levels(read.where("kind = 1"))
    if hot_level is None:
        hot_level = max(int(round(8 * log2(1 + 16 * hot))), mean_level + HOT_OVER_MEAN)
    level = spark.sparkContext.broadcast(levels)
    asked = documents.agg(F.coalesce(F.sum(F.col("size") * (1 - threshold) + AGREE), F.lit(0))).head()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), int(asked // TOKENS_A_PART) + 1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in small_batches(batches, "text"):
            part, cls, sizes, packed = [], [], [], []
            for t in batch.column(1).to_pylist():
                runs = runs_of(t, words, min_words)
                if runs is None:
                    continue
                c = _class_of(runs)
                if c in done:
                    continue
                if len(done) < 300_000:
                    done.add(c)
                tokens, lv, places = indexed_runs(runs, level.value, threshold)
                tokens = tokens & _M40 | places.astype(np.uint64) << np.uint64(40)
                common = lv >= hot_level
                where = ((tokens & _M40) % np.uint64(parts)).astype(np.int64)
                where[common] = -1
                order = np.argsort(where, kind="stable")
                where, tokens = where[order], tokens[order]
                cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]]))
                for x, y in zip(cuts, cuts[1:]):
                    p = int(where[x])
                    part.append(p if p >= 0 else c % parts)
                    cls.append(c)
                    sizes.append(len(runs) if p >= 0 else -len(runs))  # a negative size: tokens known to be hot
                    packed.append(_pack(tokens[x:y], 6))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(cls, pa.int64()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], names=["part", "cls", "size", "tokens"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, classes, sizes = [], [], []
        for b in batches:
            raw = b.column(3)
            lengths = np.asarray(pc.binary_length(raw), dtype=np.int64) // 6
            tokens.append(_unpack(b"".join(raw.to_pylist()), 6))
            classes.append(np.repeat(np.asarray(b.column(1)), lengths))
            sizes.append(np.repeat(np.asarray(b.column(2)), lengths))
        if not tokens:
            return
        t, c, s = np.concatenate(tokens), np.concatenate(classes), np.concatenate(sizes)
        del tokens, classes, sizes
        place = (t >> np.uint64(40)).astype(np.int64)
        t &= _M40
        known = s < 0
        t0, c0, s0, p0 = t[~known], c[~known], s[~known], place[~known]
        names = ["kind", "a", "b", "size", "rest"]
        step = 1 << 18
        hot_at = []
        for own in token_slices(t0, PAIRS_AT_ONCE):
            a, b, shared, rows = group_pairs(t0[own], c0[own], s0[own], p0[own], threshold, hot)
            hot_at.append(own[rows])
            for k in range(0, len(a), step):
                n = len(a[k : k + step])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(a[k : k + step]), pa.array(b[k : k + step]), pa.array(shared[k : k + step].astype(np.int32)), pa.nulls(n, pa.int32())], names=names)
        rows = np.concatenate(hot_at) if hot_at else np.zeros(0, np.int64)
        ht = np.concatenate([t[~known][rows], t[known]]).astype(np.int64)
        hc = np.concatenate([c[~known][rows], c[known]])
        hs = np.concatenate([s[~known][rows], -s[known]]).astype(np.int32)
        rest = hs - (np.concatenate([place[~known][rows], place[known]]) * hs.astype(np.int64) // 255).astype(np.int32)
        for k in range(0, len(ht), step):
            n = len(ht[k : k + step])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int8)), pa.array(ht[k : k + step]), pa.array(hc[k : k + step]), pa.array(hs[k : k + step]), pa.array(rest[k : k + step])], names=names)

    rows = src.mapInArrow(index, "part int, cls bigint, size int, tokens binary").repartitionById(parts, F.col("part"))
    paired = materialize(rows.mapInArrow(pair, "kind tinyint, a bigint, b bigint, size int, rest int"), "neardup-candidates")
    candidates = paired.where("kind = 0").groupBy("a", "b").agg(F.sum("size").alias("shared")).where(F.col("shared") >= AGREE).select("a", "b")

    def ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, na, sb, nb = (batch.column(k) for k in range(2, 6))
                keep = ring_filter(sa.to_pylist(), np.asarray(na), sb.to_pylist(), np.asarray(nb), threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    sa = sketches.select(F.col("cls").alias("a"), F.col("sketch").alias("sa"), F.col("size").alias("na"))
    sb = sketches.select(F.col("cls").alias("b"), F.col("sketch").alias("sb"), F.col("size").alias("nb"))
    passed = candidates.join(sa, "a").join(sb, "b").select("a", "b", "sa", "na", "sb", "nb").mapInArrow(ring, "a bigint, b bigint")
    hot_rows = paired.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("cls"), "size", "rest")
    if not hot_rows.isEmpty():
        passed = passed.unionByName(_hot_pairs(hot_rows, sketches, threshold, block)).distinct()
    passed = materialize(passed, "neardup-passed")
    discard(paired)
    return members, _verified(src, documents, passed, words, min_words, threshold)


def _verified(src: DataFrame, documents: DataFrame, passed: DataFrame, words: int, min_words: int, threshold: float) -> DataFrame:
    """The pairs of passed whose full sets reach the threshold. Sets are made again for one document of each class that is asked for."""
    spark = src.sparkSession
    needed = passed.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    first = documents.groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(needed, "cls").select("cls", "doc_id")
    first = materialize(first, "neardup-asked")
    width = 1 << min(MEMBER_BITS, max(17, (MEMBER_SLOTS * first.count()).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(width)).cast("int")
    asked = spark.sparkContext.broadcast(_flags(first.select(slot.alias("bucket")).distinct(), width))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            at = np.asarray(batch.column(2))
            hit = asked.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
            part = batch.filter(pa.array(hit))
            cls, packed = [], []
            for t in part.column(1).to_pylist():
                runs = runs_of(t, words, min_words)
                if runs is not None:
                    cls.append(_class_of(runs))
                    packed.append(_pack(runs, 5))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(packed, pa.binary())], names=["cls", "runs"])

    # The slots let through a few documents of other classes; those meet no pair below.
    found = src.select("doc_id", "text", slot.alias("slot")).mapInArrow(sets, "cls bigint, runs binary")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = _unpack(x, 5), _unpack(y, 5)
                both = np.sort(np.concatenate([a, b]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common + 1e-9 >= threshold * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ra = found.select(F.col("cls").alias("a"), F.col("runs").alias("ra"))
    rb = found.select(F.col("cls").alias("b"), F.col("runs").alias("rb"))
    # A class can come twice, from documents that share a slot; its pairs are then the same.
    links = materialize(passed.join(ra, "a").join(rb, "b").select("a", "b", "ra", "rb").mapInArrow(check, "a bigint, b bigint").distinct(), "neardup-links")
    discard(passed)
    discard(first)
    return links


def similar_pairs(docs: DataFrame, *, expand_up_to: int = EXPAND_UP_TO, **how) -> DataFrame:
    """(doc_id_a, doc_id_b), doc_id_a < doc_id_b: the pairs of documents with a similarity at or over the threshold.

    Pairs inside a class of equal sets are listed too. Of a class with more than expand_up_to documents only the one with the
    least id stands in pairs with other classes, and its own documents are paired with that one alone: no link between
    different texts is lost, and no group of copies becomes the square of its size.
    """
    members, links = similar_classes(docs, **how)
    sizes = members.groupBy("cls").agg(F.count("*").alias("n"), F.min("doc_id").alias("head"))
    few = members.join(sizes.where(F.col("n") > expand_up_to).select("cls", "head"), "cls", "left")
    stands = few.where("head is null or doc_id = head").select("cls", "doc_id")
    across = links.join(stands.select(F.col("cls").alias("a"), F.col("doc_id").alias("x")), "a").join(stands.select(F.col("cls").alias("b"), F.col("doc_id").alias("y")), "b").select("x", "y")
    several = members.join(sizes.where("n > 1").select("cls", "n", "head"), "cls")
    small = several.where(F.col("n") <= expand_up_to)
    inside = small.select("cls", F.col("doc_id").alias("x")).join(small.select("cls", F.col("doc_id").alias("y")), "cls").where("x < y").select("x", "y")
    star = several.where((F.col("n") > expand_up_to) & (F.col("doc_id") != F.col("head"))).select(F.col("head").alias("x"), F.col("doc_id").alias("y"))
    return across.unionByName(inside).unionByName(star).where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def groups(docs: DataFrame, *, most_rounds: int = 50, **how) -> DataFrame:
    """(doc_id, group_id, n_links): connected groups over all links; group_id is the least doc_id of the group.

    n_links counts the other classes that a document's class is linked to. Documents in no class, as they are too short,
    have no row. Labels spread to the least neighbour and jump to their label's label, so rounds go with the logarithm of a
    group's diameter; each round is a written table.
    """
    members, links = similar_classes(docs, **how)
    heads = members.groupBy("cls").agg(F.min("doc_id").alias("head"))
    ids = links.join(heads.select(F.col("cls").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("cls").alias("b"), F.col("head").alias("y")), "b").select("x", "y")
    edges = materialize(ids.unionByName(ids.select(F.col("y").alias("x"), F.col("x").alias("y"))), "groups-edges")
    labels = materialize(edges.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("label")), "groups-labels")
    for _ in range(most_rounds):
        spread = edges.join(labels.select(F.col("x").alias("y"), F.col("label").alias("theirs")), "y").groupBy("x").agg(F.min("theirs").alias("theirs"))
        step = labels.join(spread, "x", "left").select("x", F.least("label", F.coalesce("theirs", "label")).alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("x").alias("at"), F.col("label").alias("further"))
        step = materialize(step.join(jump, step["label"] == jump["at"], "left").select("x", F.least("label", F.coalesce("further", "label")).alias("label"), "old"), "groups-labels")
        former, labels = labels, step.select("x", "label")
        labels._foliospark_path = step._foliospark_path
        discard(former)
        if step.where("label <> old").isEmpty():
            break
    else:
        raise RuntimeError("groups did not settle within most_rounds")
    degree = edges.groupBy("x").agg(F.count("*").alias("n_links"))
    named = heads.join(labels, heads["head"] == labels["x"], "left").drop("x").join(degree, F.col("head") == degree["x"], "left")
    named = named.select("cls", F.coalesce("label", "head").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(named, "cls").select("doc_id", "group_id", "n_links")
