"""Splitting of oversized texts and giant files at natural boundaries (problem 1).

The work goes by ranges, never by whole files. A worker reads its range and a halo on either side, and anchors the range at
the best boundary near its start; the next range's anchor, which it finds in the halo by the same rule, is where it stops. In
between it cuts greedily. Each range's cuts and lengths are its row of a boundary table; the rows are stitched by prefix sums,
which give the number and the place of every piece in the whole, and pieces come out by their offsets alone.

Files are cut into ranges of bytes, which any worker takes; the boundary table is a written table and the prefix sums run over
one small row for each range. A text in a column is in one worker's hands anyway: it is cut into ranges of code points there
and stitched there by the same rule, so no text is shuffled, and the table is scanned once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm._arrow import small_batches
from foliospark.storage import materialize

LIMIT, OVERLAP = 4000, 200
#: Code points of a text, and bytes of a file, to a range.
RANGE = 1 << 14
FILE_RANGE = 8 << 20
#: Ranges that a task takes where there are enough of them for all cores.
RANGES_A_TASK = 64

#: Boundaries from the strongest to the weakest; a cut stands after the match.
BOUNDARIES = [
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"[\n\r  ]\s*"),
    re.compile(r"[.!?…؟۔][\"'”’»)\]]*\s+|[。！？｡।॥][\"'”’»)\]」』）]*\s*"),
    re.compile(r"[,;:،؛]\s+|[、，；：]\s*"),
    re.compile(r"\s+"),
]
_JOINED = re.compile("[̀-ͯ҃-҉֑-ֽؐ-ًؚ-ٰٟऀ-ःऺ-ॏัิ-ฺ็-๎‌‍⃐-⃰︀-️\U0001f3fb-\U0001f3ff]")


def _whole_sign(text: str, at: int, least: int) -> int:
    """The last place up to `at` where no combining sign, joiner or modifier is cut off; `at` itself if there is none after least."""
    i = at
    while i > least and i < len(text) and (_JOINED.match(text, i) or text[i - 1] == "‍"):
        i -= 1
    return i if i > least else at


def best_cut(text: str, low: int, high: int) -> int:
    """The last cut of the strongest kind in (low, high], or 0 if the stretch has no boundary at all."""
    for kind in BOUNDARIES:
        cut = 0
        for m in kind.finditer(text, low, min(len(text), high + 1)):
            if low < m.end() <= high:
                cut = m.end()
            elif m.start() < high < m.end():
                cut = high
        if cut:
            return cut
    return 0


def cut_range(text: str, begin: int, end: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (start, end) of text[begin:end]; each starts with the overlap before its cut, also the first if text reaches back."""
    out, cut = [], begin
    while cut < end:
        start = cut
        if cut > 0:
            start = max(0, cut - overlap)
            m = re.compile(r"\s\S").search(text, start, min(cut, start + overlap // 5 + 1))
            start = m.end() - 1 if m else start
            while start < cut and start > 0 and (_JOINED.match(text, start) or text[start - 1] == "‍"):
                start += 1
        high = start + limit
        if high >= end:
            nxt = end
        else:
            nxt = best_cut(text, cut + (high - cut) // 2, high) or best_cut(text, cut, high) or _whole_sign(text, high, cut)
        out.append((start, nxt))
        cut = nxt
    return out


def anchor(text: str, at: int, halo: int) -> int:
    """Where a range that begins at `at` is anchored: the first of the strongest boundaries within the halo, else the next whole sign."""
    if at <= 0:
        return 0
    for kind in BOUNDARIES:
        m = kind.search(text, at, min(len(text), at + halo))
        if m:
            return m.end()
    i = min(at, len(text))
    while i < min(len(text), at + halo) and (_JOINED.match(text, i) or text[i - 1] == "‍"):
        i += 1
    return i


def boundary_table(text: str, limit: int, overlap: int, span: int) -> list[list[tuple[int, int]]]:
    """For each range of `span` code points of text its pieces (start, end); a range looks at no more than itself and its halos."""
    halo, out = 2 * limit, []
    for low in range(0, len(text), span):
        base = max(low - halo, 0)
        part = text[base : low + span + halo]
        begin = anchor(part, low - base, limit)
        end = anchor(part, low + span - base, limit) if low + span < len(text) else len(part)
        out.append([(base + a, base + b) for a, b in cut_range(part, begin, end, limit, overlap)])
    return out


def stitched(table: list[list[tuple[int, int]]]) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of every piece: the prefix sums over the ranges' counts, and each piece's place in its range."""
    before = accumulate(map(len, table), initial=0)
    for first, pieces in zip(before, table):
        for k, (a, b) in enumerate(pieces):
            yield first + k, a, b


def _check(limit: int, overlap: int, span: int) -> None:
    if not 0 <= 2 * overlap < limit or span < 4 * limit:
        raise ValueError("the overlap must be under half the limit, a range at least four limits long")


def split_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, span: int = RANGE, with_text: bool = True) -> DataFrame:
    """(doc_id, piece_no, start_pos, end_pos[, text]) of every text, in code points from 0, end excluded; piece_no from 0.

    No piece is longer than limit. A cut stands after the last paragraph, line, sentence, clause or word end, in this order,
    in the later half of what fits, else anywhere in it, else between two signs. Each piece after the first starts with the
    last overlap code points of the one before, less up to a fifth so that it starts with a word; without these the pieces
    give the text again. An empty text is one empty piece, a null text gives none. Null and repeated ids are split like any
    other; an empty table gives no rows; other columns are not read. One scan, nothing is shuffled.
    """
    _check(limit, overlap, span)
    n = F.length(text_col)
    text = F.col(text_col) if with_text else F.when(n > limit, F.col(text_col))  # a text that is one piece is needed for itself only
    src = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), n.alias("n"), text.alias("text"))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()][: 4 + with_text]
    names = ["doc_id", "piece_no", "start_pos", "end_pos", "text"][: 4 + with_text]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in small_batches(batches, "text"):
            for i, size, t in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if size <= limit:
                    places = [(0, 0, size)]
                else:
                    places = stitched(boundary_table(t, limit, overlap, span))
                for no, a, b in places:
                    rows.append((i, no, a, b, t[a:b]) if with_text else (i, no, a, b))
                    held += b - a if with_text else 64
                    if held >= 4 << 20:
                        yield packed(rows)
                        rows, held = [], 0
        if rows:
            yield packed(rows)

    return src.mapInArrow(run, "doc_id bigint, piece_no int, start_pos bigint, end_pos bigint" + ", text string" * with_text)


def split_files(spark: SparkSession, path: str, *, limit: int = LIMIT, overlap: int = OVERLAP, span: int = FILE_RANGE, glob: str | None = None, ranges_a_task: int = RANGES_A_TASK) -> DataFrame:
    """(path, piece_no, start_byte, end_byte, n_chars, start_char) of UTF-8 files in any file system that Spark and Arrow know.

    The listing gives sizes without reading contents. Ranges are `span` bytes; no worker holds more than a range and its
    halos. Bytes that are no UTF-8 count as one code point each and are kept. Rules of cutting as in split_texts. Empty files
    give no rows.
    """
    _check(limit, overlap, span)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length").where("length > 0")
    last = F.expr(f"cast((length - 1) div {span} as int)")
    n_ranges = files.agg(F.coalesce(F.sum(last + 1), F.lit(0))).head()[0]
    tasks = max(1, min(n_ranges, 3 * spark.sparkContext.defaultParallelism), n_ranges // ranges_a_task)
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0), last)).alias("range_no")).repartition(tasks, "path", "range_no")
    halo = 8 * limit  # bytes: two limits of the longest code points

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        schema = pa.schema([("path", pa.string()), ("range_no", pa.int32()), ("n", pa.int64()), ("chars", pa.int64()), *((c, longs) for c in ("start_byte", "end_byte", "n_chars", "upto"))])
        for batch in batches:
            for name, size, r in zip(*(batch.column(c).to_pylist() for c in range(3))):
                lo = max(r * span - halo, 0)
                raw = read_bytes(name, lo, min(size, (r + 1) * span + halo))
                lead = 0
                while lo and lead < 4 and lead < len(raw) and raw[lead] & 0xC0 == 0x80:
                    lead += 1
                raw = raw[lead:]
                lo += lead
                text = raw.decode("utf-8", "surrogateescape")

                def chars(to: int, raw: bytes = raw, lo: int = lo) -> int:
                    return len(raw[: _aligned(raw, to - lo)].decode("utf-8", "surrogateescape"))

                begin = anchor(text, chars(r * span), limit) if r else 0
                end = anchor(text, chars((r + 1) * span), limit) if size > (r + 1) * span else len(text)
                starts, ends, sizes, upto = [], [], [], []
                at_char = at_byte = 0
                for a, b in cut_range(text, begin, end, limit, overlap):
                    if a >= at_char:
                        at_byte += len(text[at_char:a].encode("utf-8", "surrogateescape"))
                    else:
                        at_byte -= len(text[a:at_char].encode("utf-8", "surrogateescape"))
                    at_char = a
                    starts.append(lo + at_byte)
                    ends.append(lo + at_byte + len(text[a:b].encode("utf-8", "surrogateescape")))
                    sizes.append(b - a)
                    upto.append(b - begin)
                columns = [[name], [r], [len(starts)], [upto[-1] if upto else 0], [starts], [ends], [sizes], [upto]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    longs = "array<bigint>"
    table = ranges.select("path", "length", "range_no").mapInArrow(run, f"path string, range_no int, n bigint, chars bigint, start_byte {longs}, end_byte {longs}, n_chars {longs}, upto {longs}")
    table = materialize(table, "split-boundaries")
    w = W.partitionBy("path").orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    before = table.select("path", "range_no", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"), F.coalesce(F.sum("chars").over(w), F.lit(0)).alias("c0"))
    placed = table.join(before, ["path", "range_no"]).select("path", "n0", "c0", F.posexplode(F.arrays_zip("start_byte", "end_byte", "n_chars", "upto")).alias("k", "p"))
    return placed.select("path", (F.col("n0") + F.col("k")).alias("piece_no"), "p.start_byte", "p.end_byte", "p.n_chars", (F.col("c0") + F.col("p.upto") - F.col("p.n_chars")).alias("start_char"))


def _aligned(raw: bytes, at: int) -> int:
    """at, moved back to the start of the code point that it falls into."""
    back = 0
    while 0 < at - back < len(raw) and back < 4 and raw[at - back] & 0xC0 == 0x80:
        back += 1
    return max(0, at - back)


@lru_cache(maxsize=16)
def _file_system(root: str):
    from pyarrow import fs

    return fs.LocalFileSystem() if root in ("", "file:") else fs.FileSystem.from_uri(root)[0]


def read_bytes(name: str, start: int, stop: int) -> bytes:
    """The bytes [start, stop) of a file named as Spark names it; only these are read."""
    from urllib.parse import unquote, urlparse

    url = urlparse(name)
    if url.scheme in ("", "file"):
        root, path = "", unquote(url.path) if url.scheme else name
    else:
        root, path = f"{url.scheme}://{url.netloc}/", url.path if url.scheme in ("hdfs", "viewfs") else url.netloc + url.path
    with _file_system(root).open_input_file(path) as f:
        f.seek(start)
        return f.read(stop - start)


def read_pieces(pieces: DataFrame) -> DataFrame:
    """pieces of split_files with a column text, each read by its offsets alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for name, a, b in zip(*(batch.column(c).to_pylist() for c in ("path", "start_byte", "end_byte"))):
                texts.append(read_bytes(name, a, b).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return pieces.mapInArrow(run, f"{kinds}, text string")
