"""Byte-pair encoding and decoding over a table of distinct words.

Spark splits every text into the pre-tokenizer's words and counts them; each distinct word of the table is encoded
once; ids return to the places of the words, and decoding joins ids with their pieces.

The table that travels to the tasks holds the ``TABLE_WORDS`` most frequent words of at most ``WORD_BYTES`` bytes, so
that its size is bounded (2^18 words of 32 bytes and at most 32 ids: 42 MB at the very worst, about 6 MB in practice).
Words beyond it are rare; each task encodes the distinct ones of a batch once, in place. A join of those occurrences
by shuffle would have to move every text beside them.

Defined results: a null text is an empty one (no ids, empty decoding). Rows with equal ids stay separate rows. Columns
besides the id and the text are ignored. Special strings in a text are the special tokens, as the library has it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

#: The pre-tokenizer's pattern; (?U) gives \s its Unicode meaning.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
TABLE_WORDS = 1 << 18
WORD_BYTES = 32


def pretokens(text: Column, special: str = SPECIAL) -> Column:
    """The words of a text in order; each special string is a word of its own."""
    text = F.coalesce(text, F.lit(""))
    plain = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    quoted = special.replace("|", "\\|")
    parts = F.transform(
        F.split(text, quoted, -1),
        lambda part, i: F.concat(F.when(i > 0, F.array(F.lit(special))).otherwise(F.array().cast("array<string>")), F.regexp_extract_all(part, F.lit(PATTERN), F.lit(0))),
    )
    return F.when(F.contains(text, F.lit(special)), F.flatten(parts)).otherwise(plain)


def split(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), pretokens(F.col(text_col)).alias("words"))


def word_table(tokens: DataFrame, path: str) -> DataFrame:
    """word, n (occurrences), ids (little-endian unsigned 32-bit): every distinct word, encoded once."""
    counts = tokens.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.word_encoder(path)
        for b in common.lean(batches):
            starts, sizes, flat = encoder(common.strings(b["word"]))
            data = flat[common.gather(starts, sizes)].astype("<u4")
            ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64) * 4)).astype(np.int32)
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([b["word"], b["n"], ids], ["word", "n", "ids"])

    return counts.mapInArrow(encoded, "word string, n long, ids binary")


def frequent(table: DataFrame, most: int = TABLE_WORDS, word_bytes: int = WORD_BYTES) -> pa.Table:
    """The bounded part of the word table that is sent to all tasks: words from the count on that ``most`` words reach."""
    short = table.where(F.octet_length("word") <= word_bytes)
    least, held = None, 0
    for n, words in sorted((tuple(r) for r in short.groupBy("n").agg(F.count("*")).collect()), reverse=True):
        held += words
        if held > most:
            break
        least = n
    return short.where(F.col("n") >= least if least else F.lit(False)).select("word", "ids").toArrow()


def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The id-to-piece table: of each id the offset into the bytes of all pieces."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    own = {i: bytes(byte[c] for c in w) for w, i in spec["model"]["vocab"].items()}
    own |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    out = [own.get(i, b"") for i in range(max(own) + 1)]
    return np.cumsum([0, *map(len, out)], dtype=np.int64), np.frombuffer(b"".join(out), np.uint8)


class _Coder:
    """Encodes batches of word lists with the sent table, and a task's own store for words beyond it."""

    def __init__(self, path: str, words: pa.Array, ends: np.ndarray, ids: np.ndarray):
        self.own, self.words = common.word_encoder(path), words
        self.starts, self.sizes, self.ids = ends[:-1], np.diff(ends), ids

    def __call__(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each row's ids and the ids of all rows."""
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        o = lists.offsets.to_numpy().astype(np.int64)
        codes, distinct = common.coded(lists.values.slice(o[0], o[-1] - o[0]))
        at = pc.index_in(distinct, value_set=self.words)
        rare = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy(zero_copy_only=False)
        starts, sizes, ids = (self.starts[at], self.sizes[at], self.ids) if len(self.words) else (np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), self.ids)
        if len(rare):
            s, n, more = self.own(distinct.take(pa.array(rare)))
            starts[rare], sizes[rare] = s + len(ids), n
            ids = np.concatenate((ids, more))
        each = sizes[codes]
        total = np.concatenate(([0], np.cumsum(each, dtype=np.int64)))
        return total[o - o[0]], ids[common.gather(starts[codes], each)]


def _sent(spark: SparkSession, table: pa.Table):
    ids = table["ids"].combine_chunks() if table.num_rows else pa.array([], pa.binary())
    ids = ids.cast(pa.binary())
    ends = np.zeros(1, np.int64)
    flat = np.zeros(0, np.uint32)
    if len(ids):
        raw = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
        ends, flat = (raw - raw[0]) // 4, np.frombuffer(ids.buffers()[2], "<u4")[raw[0] // 4 : raw[-1] // 4].astype(np.uint32)
    words = table["word"].combine_chunks().cast(pa.string()) if table.num_rows else pa.array([], pa.string())
    return common.broadcast_value(spark, (words, ends, flat))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every text."""
    tokens = split(docs, id_col, text_col)
    sent = _sent(docs.sparkSession, frequent(common.table(word_table(tokens, path), "words")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(path, *sent.value)
        for b in common.lean(batches):
            o, ids = coder(b["words"])
            out = pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], out], ["doc_id", "ids"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def _texts(o: np.ndarray, ids: np.ndarray, piece_at: np.ndarray, piece_bytes: np.ndarray) -> list[bytes]:
    """Ids joined with their pieces; each row's bytes, with U+FFFD for what isn't UTF-8."""
    sizes = np.diff(piece_at)[ids]
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[o]
    data = piece_bytes[common.gather(piece_at[ids], sizes)].tobytes()
    return [data[i:j].decode("utf-8", "replace").encode() for i, j in zip(ends[:-1], ends[1:])]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: rows of ids (null: empty) joined with their pieces; special tokens are kept."""
    sent = common.broadcast_value(encoded.sparkSession, pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, data = sent.value
        for b in batches:
            lists = b["ids"].fill_null(pa.scalar([], b["ids"].type)) if b["ids"].null_count else b["ids"]
            o = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.slice(o[0], o[-1] - o[0]).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([x.decode() for x in _texts(o - o[0], ids, at, data)], pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text in one pass over the word lists: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    tokens = split(docs)
    sent = _sent(spark, frequent(common.table(word_table(tokens, path), "words")))
    parts = common.broadcast_value(spark, pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(path, *sent.value)
        at, data = parts.value
        for b in common.lean(batches):
            o, ids = coder(b["words"])
            raw = ids.astype("<u4").tobytes()
            sha = [hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(o[:-1], o[1:])]
            back = [hashlib.sha256(x).hexdigest() for x in _texts(o, ids, at, data)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.diff(o)), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
