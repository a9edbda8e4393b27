"""Encoding of a corpus with a public byte-level tokenizer, and the way back (problem 6).

The tokenizers library runs over Arrow batches, one tokenizer for each Python worker. A token is a string over an alphabet of
256 visible characters, one for each byte; that table is built from its rule. Offsets of tokens are given in characters, and
decoding goes from tokens to bytes first, so a character that is split over several tokens comes back whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm._arrow import each_batch, list_of

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, one for each process; strings of special tokens in a text are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


def _sent(spark: SparkSession, path: str) -> None:
    """Gives the tokenizer's file to every executor, for those that do not have it at its path."""
    if os.path.exists(path):
        spark.sparkContext.addFile(path)


def byte_of_char() -> dict[str, int]:
    """The byte that each character of the byte alphabet stands for: printable Latin-1 bytes are themselves, the others follow from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each token id."""
    table = byte_of_char()
    return {i: bytes(table[c] for c in s) for s, i in load(path).get_vocab(with_added_tokens=False).items() if all(c in table for c in s)}


def decode_ids(ids: list[int], path: str = BYTE_BPE_50K) -> str:
    """The text of token ids. Bytes that are no UTF-8 (a cut inside a character) become U+FFFD."""
    table = token_bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def _encode(texts: list[str], path: str) -> list:
    return load(path).encode_batch_fast(texts, add_special_tokens=False)


def encode_ids(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE_50K) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text without special tokens.

    An empty list for an empty and for a null text. One row for each row of docs, null and repeated ids included; an empty
    table gives no rows; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [e.ids for e in _encode([t or "" for t in batch.column(1).to_pylist()], tokenizer)]
        flat = np.fromiter((i for row in ids for i in row), dtype=np.int32, count=sum(map(len, ids)))
        return pa.RecordBatch.from_arrays([batch.column(0), list_of(flat, [len(r) for r in ids])], schema=schema)

    _sent(docs.sparkSession, tokenizer)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each_batch(encode, "text"), "doc_id bigint, ids array<int>")


def count_tokens(docs: DataFrame, *keep: str, text_col: str = "text", tokenizer: str = BYTE_BPE_50K) -> DataFrame:
    """The columns keep and n_tokens (bigint) of each row's text; 0 for an empty and for a null text."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [len(e) for e in _encode([t or "" for t in batch.column(len(keep)).to_pylist()], tokenizer)]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    _sent(docs.sparkSession, tokenizer)
    picked = docs.select(*keep, F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)])
    return picked.mapInArrow(each_batch(count, "_text"), f"{kinds}, n_tokens bigint")


def token_offsets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE_50K) -> DataFrame:
    """(doc_id, ids, starts, ends): with each id the characters [start, end) of the text that its bytes belong to.

    Tokens inside one split character all have that character's place. Empty lists for an empty and for a null text.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.list_(pa.int32())) for n in ("ids", "starts", "ends"))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoded = load(tokenizer).encode_batch([t or "" for t in batch.column(1).to_pylist()], add_special_tokens=False)
        lengths = [len(e) for e in encoded]
        flat = np.array([i for e in encoded for i in e.ids], dtype=np.int32)
        places = np.array([o for e in encoded for o in e.offsets], dtype=np.int32).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([batch.column(0), *(list_of(np.ascontiguousarray(c), lengths) for c in (flat, places[:, 0], places[:, 1]))], schema=schema)

    _sent(docs.sparkSession, tokenizer)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each_batch(run, "text"), "doc_id bigint, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = BYTE_BPE_50K, most_ids: int = 1 << 20) -> DataFrame:
    """(doc_id, text) from token ids; a null list gives a null text. About most_ids ids are decoded at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0), dtype=np.int64)
            block = np.cumsum(sizes) // most_ids
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            for part in (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a):
                texts = [None if r is None else decode_ids(r, tokenizer) for r in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    _sent(encoded.sparkSession, tokenizer)
    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id bigint, text string")
