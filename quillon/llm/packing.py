"""Packing of token pieces into sequences by minimum bin slack.

For each bin the largest piece that is left is laid in, and a bitset dynamic programme over the available lengths finds
the fullest feasible rest; bit s of the set says that some choice of pieces fills s tokens. The combination is removed
and the next bin begins. Pieces of one length are alike, so the programme runs on the histogram of lengths (at most
``capacity`` numbers, whatever the input) and a combination is laid as often as the histogram allows. Spark then deals the
pieces of each length out to the planned places by their rank.

Defined results: a null text is empty and makes a piece of the end token alone. Repeated rows are packed each on its
own. Only documents of more than ``capacity`` tokens are cut. An empty table gives no rows; other columns are ignored. A text
of any length is encoded whole. Texts with a character outside ``PLAIN`` or a special string go through the library as they
are, in batches; the others are cut into words a batch at a time, and each distinct word is encoded.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import common

CAPACITY = 4096
END = 1
#: Rows of one length that are ranked together.
GROUP = 50_000
#: Characters of which texts are in normal form C, whatever stands beside them, and whose lower case is one character wherever
#: they stand: Latin, Greek (but capital sigma), Cyrillic, Hebrew and Arabic letters, punctuation, currency, arrows and
#: symbols, kana, Chinese characters, Hangul syllables, full-width forms, emoji. Combining marks that compose aren't among them.
PLAIN = (
    (0x0000, 0x02FF), (0x0391, 0x03A1), (0x03A4, 0x03CE), (0x0400, 0x0482), (0x048A, 0x052F), (0x05D0, 0x05EA),
    (0x060C, 0x060C), (0x061B, 0x061B), (0x061F, 0x061F), (0x0621, 0x064A), (0x0660, 0x0669), (0x2002, 0x2027), (0x202F, 0x205F),
    (0x20A0, 0x20BF), (0x2190, 0x21FF), (0x2200, 0x2328), (0x232B, 0x23FF), (0x2500, 0x27BF), (0x3000, 0x3029), (0x3041, 0x3096), (0x309B, 0x309C),
    (0x30A0, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFE0F, 0xFE0F), (0xFF01, 0xFF60), (0x1F300, 0x1F64F),
    (0x1F680, 0x1F6D0), (0x1F900, 0x1F92F),
)
#: A character outside them, as a pattern for Spark.
OTHER = r"(?![\x{0}-\x{12F}])[^" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in PLAIN) + "]"
#: Kinds of characters. Those from BEYOND on are in no text that is cut here.
SPACE, LETTER, NUMBER, SIGN = range(4)
BEYOND = 0x20000
#: Most distinct words that a worker process holds with their ids.
HELD = 400_000
#: The store counts as full, too, when it has more ids than so many times its limit of words: long words take more room.
IDS = 8


class Item(NamedTuple):
    length: int
    copies: int
    offset: int


class Bin(NamedTuple):
    first: int  # sequence id of the first of ``times`` equal bins
    times: int
    items: list[Item]


def fullest(lengths: list[tuple[int, int]], slack: int) -> list[tuple[int, int]]:
    """(length, copies) whose sum is the largest of at most ``slack``; lengths: (length, available), longest first."""
    reach, most, stages = 1, (1 << (slack + 1)) - 1, []
    for length, left in lengths:
        if length > slack:
            continue
        left = min(left, slack // length)
        copies = 1
        while left:  # 1, 2, 4, ... and the rest make every number of copies
            n = min(copies, left)
            stages.append((length, n, reach))
            reach |= (reach << (length * n)) & most
            left, copies = left - n, copies * 2
        if reach >> slack & 1:
            break
    fill, chosen = reach.bit_length() - 1, {}
    for length, n, before in reversed(stages):
        if not before >> fill & 1:
            chosen[length] = chosen.get(length, 0) + n
            fill -= length * n
    return sorted(chosen.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Bin]:
    """Bins for all pieces of the histogram."""
    left = dict(sorted(histogram.items(), reverse=True))
    bins, sequence = [], 0
    while left:
        largest = next(iter(left))
        rest = [(n, c - (n == largest)) for n, c in left.items()]
        need = dict(fullest([x for x in rest if x[1]], capacity - largest))
        need[largest] = need.get(largest, 0) + 1
        times = min(left[n] // c for n, c in need.items())
        items, offset = [], 0
        for n, c in sorted(need.items(), reverse=True):
            items.append(Item(n, c, offset))
            offset += n * c
            left[n] -= c * times
            if not left[n]:
                del left[n]
        bins.append(Bin(sequence, times, items))
        sequence += times
    return bins


@functools.cache
def kinds() -> np.ndarray:
    """The kind of every character below ``BEYOND``, by its Unicode category."""
    by = {"L": LETTER, "N": NUMBER}
    out = np.array([by.get(unicodedata.category(chr(x))[0], SIGN) for x in range(BEYOND)], np.uint8)
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


@functools.cache
def plain() -> np.ndarray:
    """Whether a character is in ``PLAIN``, for every character below ``BEYOND``."""
    out = np.zeros(BEYOND, bool)
    for a, b in PLAIN:
        out[a : b + 1] = True
    return out


@functools.cache
def lower_narrow() -> np.ndarray:
    """The lower case of the first 256 characters, all of which stay among these."""
    return np.frombuffer("".join(map(chr, range(256))).lower().encode("latin-1"), np.uint8)


def cut(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pre-tokenizer's words of lower-case characters: where each starts, where it ends, and which characters are in words.

    Its pattern: 's|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+
    """
    n = len(codes)
    kind = np.zeros(n + 3, np.uint8)  # white space behind the end
    kind[:n] = kinds()[codes]
    turn = kind[1:] != kind[:-1]
    number, inside = kind == NUMBER, kind != SPACE
    first = number.copy()
    first[0] = True
    first[1:] |= turn
    first &= inside
    stop = np.zeros(n + 3, bool)
    stop[1:] = (turn | number[:-1]) & inside[:-1]
    quotes = np.flatnonzero(codes == ord("'"))
    quotes = quotes[first[quotes] & (kind[quotes + 1] == LETTER)]
    if len(quotes):
        x, y = codes[quotes + 1], codes[np.minimum(quotes + 2, n - 1)]
        y = np.where(quotes + 2 < n, y, 0)
        one = np.isin(x, [ord(c) for c in "stmd"])
        two = (((x == ord("r")) | (x == ord("v"))) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        at, size = quotes[one | two], np.where(one, 1, 2)[one | two]
        first[at + 1] = stop[at + 1] = False
        stop[at + 1 + size] = True
        first[at + 1 + size] |= kind[at + 1 + size] == LETTER
    return np.flatnonzero(first), np.flatnonzero(stop), inside[:n]


class Words(common.WordEncoder):
    """Ids of words as lists of strings. When the store is full, words that the batch at hand has stay in it."""

    def __call__(self, own: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = self.rows
        if len(rows) + len(own) > self.limit or len(self.flat) > IDS * self.limit:
            stay = [w for w in own if w in rows]
            at = np.fromiter(map(rows.__getitem__, stay), np.int64, len(stay))
            starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
            self.flat, self.sizes = self.flat[common.gather(starts[at], self.sizes[at])], self.sizes[at]
            rows = self.rows = dict(zip(stay, range(len(stay))))
        new = [w for w in own if w not in rows]
        if new:
            sizes, flat = self.encode(new)
            rows.update(zip(new, range(len(rows), len(rows) + len(new))))
            self.sizes, self.flat = np.append(self.sizes, sizes), np.append(self.flat, flat)
        at = np.fromiter(map(rows.__getitem__, own), np.int64, len(own))
        starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        return starts[at], self.sizes[at], self.flat


@functools.lru_cache(maxsize=4)
def store(path: str) -> Words:
    """The worker process's own store of encoded words."""
    return Words(path, True, HELD)


def ids_of(codes: np.ndarray, ends: np.ndarray, coding: str, encoder: Words) -> list[bytes]:
    """Ids (little-endian, unsigned, 32 bits) of texts of lower-case characters; each text ends, with a white space, where ``ends`` says."""
    starts, stops, inside = cut(codes)
    wide = codes.dtype.itemsize
    at = np.concatenate(([0], np.cumsum(stops - starts, dtype=np.int64)))
    chars = np.ascontiguousarray(codes[inside])
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at * wide), pa.py_buffer(chars)])
    word, distinct = common.coded(flat)
    _, offsets, data = distinct.buffers() if len(distinct) else (None, np.zeros(1, np.int64), b"")
    o = (np.frombuffer(offsets, np.int64)[distinct.offset : distinct.offset + len(distinct) + 1] // wide).tolist()
    every = bytes(data or b"")[: o[-1] * wide].decode(coding)
    begin, sizes, ids = encoder([every[i:j] for i, j in zip(o[:-1], o[1:])])
    each = sizes[word]
    total = np.concatenate(([0], np.cumsum(each, dtype=np.int64)))[np.searchsorted(starts, ends)]
    raw = ids[common.gather(begin[word], each)].astype("<u4").tobytes()
    return [raw[4 * i : 4 * j] for i, j in zip(np.concatenate(([0], total[:-1])).tolist(), total.tolist())]


def encoded(texts: list[str], path: str) -> list[bytes]:
    """Ids of whole texts: those of the first 256 characters and those of ``PLAIN`` word by word, others by the library."""
    encoder, whole = store(path), common.tokenizer(path)
    own_batch = getattr(whole, "encode_batch_fast", whole.encode_batch)
    ids: list[bytes] = [b""] * len(texts)
    narrow, wide, rest = ([], []), ([], []), []
    for row, text in enumerate(texts):
        if "<|" in text:  # a special string perhaps
            rest.append(row)
            continue
        try:
            narrow[1].append(text.encode("latin-1"))
            narrow[0].append(row)
        except UnicodeEncodeError:
            if plain()[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), BEYOND - 1)].all():
                wide[1].append(text.lower().encode("utf-32-le"))
                wide[0].append(row)
            else:
                rest.append(row)
    for (rows, parts), space, coding, kind in ((narrow, b" ", "latin-1", np.uint8), (wide, " ".encode("utf-32-le"), "utf-32-le", np.dtype("<u4"))):
        if not rows:
            continue
        codes = np.frombuffer(space.join([*parts, b""]), kind)
        ends = np.cumsum([len(x) // codes.itemsize + 1 for x in parts])
        for row, x in zip(rows, ids_of(lower_narrow()[codes] if coding == "latin-1" else codes, ends, coding, encoder)):
            ids[row] = x
    for i in range(0, len(rest), 64):
        for row, x in zip(rest[i : i + 64], own_batch([texts[row] for row in rest[i : i + 64]], add_special_tokens=False)):
            ids[row] = np.asarray(x.ids, "<u4").tobytes()
    return ids


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every whole text's ids and the end token."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.asarray([end], "<u4").tobytes()
        for b in common.lean(batches):
            out = []
            for row, x in enumerate(encoded(common.strings(b["text"]).to_numpy(zero_copy_only=False).tolist(), path)):
                x += last
                out += [(row, k, s // 4, len(p) // 4, zlib.crc32(p)) for k, s in enumerate(range(0, len(x), 4 * capacity)) for p in (x[s : s + 4 * capacity],)]
            row, piece, start, length, crc = (np.array(c, np.int64) for c in (zip(*out) if out else [()] * 5))
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """Adds n: each row's place, from 0, among those of its length. Large lengths are ranked in groups."""
    groups = -(-max(total, 1) // GROUP)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("length", "part").agg(F.count("*").alias("c")).select("length", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    return rows.withColumn("place", inside).join(bases, ["length", "part"]).withColumn("n", F.col("base") + F.col("place") - 1).drop("part", "base", "place")


def lookup(bins: list[Bin]) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank) of all items, and of each its bin's first sequence, copies and offset."""
    used: dict[int, int] = {}
    rows = []
    for b in bins:
        for item in b.items:
            first = used.get(item.length, 0)
            rows.append(((item.length << 44) + first, first, b.first, item.copies, item.offset))
            used[item.length] = first + b.times * item.copies
    rows.sort()
    return tuple(np.array(x, np.int64) for x in (zip(*rows) if rows else [()] * 5))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    rows = common.table(pieces(docs, path, capacity), "pieces")
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    sent = common.broadcast_value(docs.sparkSession, lookup(plan(histogram, capacity)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, sequences, copies, offsets = sent.value
        for b in batches:
            length, n = b["length"].to_numpy(), b["n"].to_numpy()
            at = np.searchsorted(keys, (length << 44) + n, side="right") - 1
            turn, copy = np.divmod(n - firsts[at], copies[at])
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequences[at] + turn), pa.array(offsets[at] + copy * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked(rows, sum(histogram.values())).mapInArrow(run, schema)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the places of all pieces of the documents that are left."""
    import public_tokenizers

    common.small_batches(spark)
    return pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
