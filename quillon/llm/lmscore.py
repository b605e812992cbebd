"""Language-model scores from a log-frequency Bloom filter.

Counting gives every training word's and word pair's number. A count c is quantised to q = 1 + floor(log2 c), and the
filter holds (n-gram, 1) ... (n-gram, q), for words and pairs of every count. A scorer learns q by probing
(n-gram, 1), (n-gram, 2), ... until a probe fails, so it never reads a count too low, and by false positives seldom one
too high. The model interpolates the pair's relative frequency with the word's smoothed one:

    p(w | v) = l(v) * c(v w) / c(v) + (1 - l(v)) * (c(w) + ADD) / (N + ADD * (V + 1)),   l(v) = WEIGHT * c(v) / (c(v) + HALF)

with the counts as the filter gives them (a q stands for 1.4 * 2^(q - 1), and 1 for itself). A text starts with a begin
mark that is no token, and ends with an end mark that is one.

Rows are packed into chunks. N-grams are spread by hash over buckets; each chunk sends every bucket the sorted hashes of its
n-grams with their training counts, a bucket merges them, builds its own stretch of the filter and answers each chunk with
the levels that probes give. Chunks meet their answers in a join, so the filter is never sent or gathered: it has at
least ``BITS_PER_TOKEN`` bits a training token and ``BITS_PER_LEVEL`` bits for each (n-gram, q) in it at every size, and a
task holds one bucket's stretch. Exact word counts for
``base_score`` are broadcast for the most frequent words (2^20 at most, 16 MB); occurrences of rarer ones meet their counts
in a join.

Words are known by 64-bit hashes, pairs within a bucket by 32 bits more, finer than the filter tells them apart.

Defined results: null texts are empty: one token, the end. A null id counts as the empty text in the fold. Without
training rows N and V are 0 and every token has log10(1 / 1). Rows that share an id are scored each on its own. An empty
table gives no rows. A text of any length is scored whole, as one row of a chunk. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

ADD = 0.1
WEIGHT, HALF = 0.5, 4.0
PROBES = 4
BITS_PER_TOKEN, BITS_PER_LEVEL, LEAST_BITS = 2, 16, 20
MOST_WORDS = 1 << 20
#: Training tokens for each bucket, about.
BUCKET = 1 << 20
FOLDS = 10
END, BEGIN = (int(common.mix(np.array([x], np.uint64))[0]) for x in (3, 5))
#: Bytes of text that make a chunk.
HELD = 16 << 20


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's tokens start, and their hashes; each text ends with END."""
    o, flat = common.split_words(texts, lower=True)
    codes, distinct = common.coded(flat)
    words = common.hash_strings(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    at = o + np.arange(len(o))
    out = np.full(at[-1], np.uint64(END))
    inside = np.ones(len(out), bool)
    inside[at[1:] - 1] = False
    out[inside] = words
    return at, out


def pairs(at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before it, BEGIN for a text's first."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[at[:-1]] = np.uint64(BEGIN)
    return common.mix(before * np.uint64(0x9E3779B97F4A7C15) + h)


def packed(rows: DataFrame) -> DataFrame:
    """chunk, rows, tokens: all columns of about ``HELD`` bytes of text as one compressed Arrow stream, under a number of its own;
    the number of training tokens in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, k = [], 0, TaskContext.get().partitionId() << 32

        def sent() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for x in own:
                    out.write_batch(x)
            tokens = sum(training_tokens(common.strings(x["text"]), x["held_out"].to_numpy(zero_copy_only=False)) for x in own)
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([tokens], pa.int64())], ["chunk", "rows", "tokens"])

        for b in common.lean(batches):
            if not b.num_rows:
                continue
            own.append(b)
            n += b.nbytes
            if n >= HELD:
                yield sent()
                own, n, k = [], 0, k + 1
        if own:
            yield sent()

    return rows.mapInArrow(run, "chunk long, rows binary, tokens long")


def training_tokens(texts: pa.Array, held_out: np.ndarray) -> int:
    """Words and ends of the texts that aren't held out."""
    o, b = common.buffers(texts)
    inside = np.append(False, ~((b == 32) | ((b >= 9) & (b <= 13))))
    first = inside[1:] & ~inside[:-1]
    at = o[:-1][o[:-1] < len(b)]
    first[at] = inside[1:][at]
    each = np.diff(np.concatenate(([0], np.cumsum(first)))[o]) + 1
    return int(each[~held_out].sum())


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def counted(chunks: DataFrame, bits: int) -> DataFrame:
    """chunk, pair, bucket, grams, few, many: sorted hashes of a chunk's distinct words or pairs in a bucket, and their training counts."""

    def sent(chunk: int, h: np.ndarray, held: np.ndarray, pair: bool) -> pa.RecordBatch:
        values, numbers = np.unique(h, return_counts=True)
        others, n = np.unique(h[held], return_counts=True)
        numbers[np.searchsorted(values, others)] -= n
        bucket = (values >> np.uint64(32 if pair else 64 - bits)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        values = values.astype(np.uint32) if pair else values
        own = [k for k in range(1 << bits) if cuts[k + 1] > cuts[k]]
        numbers = numbers.astype(np.uint32)
        few = np.minimum(numbers, 255).astype(np.uint8)
        rows = [[values[cuts[k] : cuts[k + 1]].tobytes() for k in own], [few[cuts[k] : cuts[k + 1]].tobytes() for k in own], [(n := numbers[cuts[k] : cuts[k + 1]])[n >= 255].tobytes() for k in own]]
        return pa.RecordBatch.from_arrays([pa.array([chunk] * len(own), pa.int64()), pa.array([pair] * len(own), pa.bool_()), pa.array(own, pa.int32()), *(pa.array(r, pa.binary()) for r in rows)], ["chunk", "pair", "bucket", "grams", "few", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.lean(batches):
            for chunk, data in zip(b["chunk"].to_pylist(), b["rows"]):
                t = unpacked(data.as_py())
                at, h = tokens(common.strings(t["text"]))
                held = np.repeat(t["held_out"].to_numpy(), np.diff(at))
                yield sent(chunk, h, held, False)
                yield sent(chunk, _placed(pairs(at, h), bits), held, True)

    return chunks.mapInArrow(run, "chunk long, pair boolean, bucket int, grams binary, few binary, many binary")


def _placed(h: np.ndarray, bits: int) -> np.ndarray:
    """What is kept of pairs: bucket and 32 bits."""
    return h >> np.uint64(32 - bits)


def _places(h: np.ndarray, level: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """512-bit block within a stretch of ``size`` bits, and 9 bits for each probe, of (n-gram, level)."""
    x = common.mix(h + level.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return (x >> np.uint64(40)).astype(np.int64) % max(size // 512, 1), x


def quantised(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)  # 1 + floor(log2 c)


def stretch(grams: np.ndarray, levels: np.ndarray, first: int, size: int) -> np.ndarray:
    """The bits, as bytes, that hold (n-gram, first) ... (n-gram, level)."""
    out = np.zeros(size, bool)
    for q in range(first, int(levels.max(initial=0)) + 1):
        own = grams[levels >= q]
        block, x = _places(own, np.full(len(own), q), size)
        for j in range(PROBES):
            out[block * 512 + (x >> np.uint64(9 * j) & np.uint64(511)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


def merged(parts: DataFrame, size: int) -> DataFrame:
    """One row for each of parts: levels, as the bucket's stretch of the filter gives them (a byte for each of grams).
    One more for each bucket of words, without chunk: grams and numbers, with exact counts."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, bucket = key[0].as_py(), key[1].as_py()
        kind = np.uint32 if pair else np.uint64
        chunks, values, numbers = [], [], []
        for b in common.lean(batches):
            chunks += b["chunk"].to_pylist()
            for g, f, m in zip(b["grams"].to_pylist(), b["few"].to_pylist(), b["many"].to_pylist()):
                n = np.frombuffer(f, np.uint8).astype(np.int64)
                n[n == 255] = np.frombuffer(m, np.uint32)
                values.append(np.frombuffer(g, kind))
                numbers.append(n)
        h, place = np.unique(np.concatenate(values), return_inverse=True)
        n = np.bincount(place, np.concatenate(numbers), len(h)).astype(np.int64)
        own, known = _pair_key(h.astype(np.uint64)) if pair else h, n > 0
        q = quantised(n[known])
        full = max(size, -(-BITS_PER_LEVEL * int(q.sum()) // 512) * 512)
        levels = Filter(0, full, stretch(own[known], q, 1, full))._probe(np.zeros(len(h), np.int64), own, 1).astype(np.uint8)[place]
        ends = np.cumsum([len(x) for x in values])
        answers = [levels[e - len(x) : e].tobytes() for x, e in zip(values, ends)]
        grams, counts = [None] * len(chunks), [None] * len(chunks)
        if not pair:
            chunks, answers, grams, counts = [*chunks, None], [*answers, None], [*grams, h[known].tobytes()], [*counts, n[known].tobytes()]
        k = len(chunks)
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([pair] * k, pa.bool_()), pa.array([bucket] * k, pa.int32()), *(pa.array(x, pa.binary()) for x in (answers, grams, counts))], ["chunk", "pair", "bucket", "levels", "grams", "numbers"])

    return parts.groupBy("pair", "bucket").applyInArrow(run, "chunk long, pair boolean, bucket int, levels binary, grams binary, numbers binary")


def _pair_key(rest: np.ndarray) -> np.ndarray:
    return common.mix(rest + np.uint64(0xA0761D6478BD642F))


class Filter:
    """Counts of n-grams, read by repeated probes."""

    def __init__(self, bits: int, size: int, data: np.ndarray):
        """data: the stretches of the buckets; size: bits of each."""
        self.bits, self.size, self.data = bits, size, data

    def _probe(self, stretch_at: np.ndarray, grams: np.ndarray, first: int) -> np.ndarray:
        """The largest q with (n-gram, first) ... (n-gram, q) in the filter; first - 1 where there is none."""
        out = np.full(len(grams), first - 1)
        left = np.arange(len(grams))
        for q in range(first, 64):
            block, x = _places(grams[left], np.full(len(left), q), self.size)
            base = stretch_at[left] * (self.size // 8) + block * 64
            held = np.ones(len(left), bool)
            for j in range(PROBES):
                bit = (x >> np.uint64(9 * j)) & np.uint64(511)
                held &= (self.data[base + (bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            left = left[held]
            if not len(left):
                break
            out[left] = q
        return out

    def words(self, h: np.ndarray) -> np.ndarray:
        return self._count(self._probe((h >> np.uint64(64 - self.bits)).astype(np.int64), h, 1), 1)

    @staticmethod
    def _count(q: np.ndarray, first: int) -> np.ndarray:
        return np.where(q < first, 0.0, np.where(q == 1, 1.0, 1.4 * 2.0 ** (q - 1)))


def model_scores(word: np.ndarray, pair: np.ndarray, at: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 probability of each text, from its tokens' counts and those of the pairs that end there."""
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[at[:-1]] = word[at[1:] - 1]  # as many texts begin as end
    together = np.minimum(pair, np.minimum(before, word))
    share = WEIGHT * before / (before + HALF)
    p = share * together / np.maximum(before, 1) + (1 - share) * (word + ADD) / (n + ADD * (v + 1)) if n else np.ones(len(word))
    return common.segment_sum(np.log10(np.minimum(p, 1)), at)


def shape(n: float) -> tuple[int, int]:
    """For n training tokens: 2 to the first is the number of buckets of words, as of pairs; bits that each one's stretch has at least."""
    bits = max(4, int(max(n / BUCKET, 1)).bit_length())
    total_bits = max(LEAST_BITS, int(n * BITS_PER_TOKEN).bit_length())
    return bits, max(512, (1 << total_bits) >> (bits + 1))


def score(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns where ``held_out`` is false."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    chunks = common.table(packed(rows), "chunks")
    bits, size = shape(chunks.agg(F.sum("tokens")).first()[0] or 0)
    chunks = chunks.drop("tokens")
    made = common.table(merged(counted(chunks, bits), size), "counts")
    common.release(spark)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.lean(batches):
            for g, n in zip(b["grams"].to_pylist(), b["numbers"].to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(g, np.int64)), pa.array(np.frombuffer(n, np.int64))], ["gram", "c"])

    counts = made.where("chunk IS NULL").select("grams", "numbers").mapInArrow(spread, "gram long, c long")
    by_count = sorted((tuple(r) for r in counts.groupBy("c").agg(F.count("*")).collect()), reverse=True)
    n, v = sum(c * k for c, k in by_count), sum(k for _, k in by_count)
    least, held = (by_count[0][0] + 1 if by_count else 1), 0
    for c, k in by_count:  # the most frequent words, as many as fit
        held += k
        if held > MOST_WORDS:
            break
        least = c
    t = counts.where(F.col("c") >= least).toArrow()
    grams = t["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    head = common.broadcast_value(spark, (grams[order], t["c"].to_numpy()[order]))
    under = np.log10((1 + ADD * (v + 1)) if not n else (n + ADD * (v + 1)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        common.trim()  # what the group before left
        known, numbers = head.value
        b = unpacked(left["rows"][0].as_py())
        levels = {False: [], True: []}
        for pair, _, x in sorted(zip(right["pair"].to_pylist(), right["bucket"].to_pylist(), right["levels"].to_pylist())):
            levels[pair].append(np.frombuffer(x, np.uint8))
        at, h = tokens(common.strings(b["text"]))
        values, place = np.unique(h, return_inverse=True)
        spot = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
        there = (known[spot] == values) if len(known) else np.zeros(len(values), bool)
        each = np.where(there, np.log10((numbers[spot] if len(known) else 0) + ADD) - under, 0.0)
        rare = ~there[place]
        cuts = np.concatenate(([0], np.cumsum(rare)))[at]
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(h[rare].view(np.int64)))
        word = Filter._count(np.concatenate(levels[False]).astype(np.int64), 1)[place]
        base = common.segment_sum(each[place], at)
        del values, place, spot, there, each, rare
        placed = _placed(pairs(at, h), bits)
        del h
        place = np.unique(placed, return_inverse=True)[1]
        del placed
        pair = Filter._count(np.concatenate(levels.pop(True)).astype(np.int64), 1)[place]
        del place
        common.trim()
        return pa.table(
            [b["doc_id"], b["held_out"], pa.array(np.diff(at)), pa.array(np.diff(at) - np.diff(cuts)), pa.array(base), pa.array(model_scores(word, pair, at, n, v)), lists],
            ["doc_id", "held_out", "n_tokens", "n_head", "head_score", "score", "rare"],
        )

    kind = rows.schema["doc_id"].dataType.simpleString()
    answers = made.where("chunk IS NOT NULL").select("chunk", "pair", "bucket", "levels")
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_head long, head_score double, score double, rare array<long>")
    scored = common.table(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    found = scored.select("row", F.explode("rare").alias("gram")).join(counts.where(F.col("c") < least), "gram", "left")
    c = F.coalesce("c", F.lit(0))
    tail = found.groupBy("row").agg(F.sum((c > 0).cast("long")).alias("n_tail"), F.sum(F.log10(c + F.lit(ADD)) - F.lit(float(under))).alias("tail_score"))
    base = F.lit(0.0) if not n else F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))
    return scored.drop("rare").join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir).select("doc_id", "text"), common.fold("doc_id", FOLDS) == 0)
