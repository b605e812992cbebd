"""Removal of passages that a document with a smaller id holds too, by FM-indexes over shards.

Every window of ``window`` words has an anchor: its ``GRAM`` consecutive words of the least hash. Equal windows have equal
anchors, so a window can only repeat where its anchor does. Runs of windows with one anchor are segments; those whose
anchor is found in two documents or more are candidates, and go to the shard of their anchor. Equal segments travel
once, with their smallest document. A shard holds an FM-index over its segments, and its segments are streamed through
it by backward search: matching statistics cut at the window's length give each window's smallest document. Runs of windows with a
smaller document than a segment's own become the intervals of that document that are removed.

Segments of an anchor with more than ``GROUP`` different texts are dealt to parts of about that many, and each pair of parts is a
group: the one is indexed, the other searched in it. A task holds one index of about ``SHARD`` segments and one batch of those that
are searched in it, and no group grows with its anchor.

Defined results: null texts have no words. Rows with a null id are neither changed nor a source. Rows that share an id
are no sources for each other, and keep their texts apart. Kept words are joined by one space. An empty table gives no
rows. A text of any length is looked at whole, in pieces of at most ``MOST`` words. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common
from quillon.llm.fmindex import FMIndex

WINDOW = 50
GRAM = 8
GROUP = 4096
#: Segments that share an index, about.
SHARD = 8192
#: Words whose windows are looked at together.
MOST = (1 << 24) - 1
MISSING = np.iinfo(np.int64).max
B = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def segments(texts: pa.Array, window: int, gram: int, most: int = MOST) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows, anchor and content of all segments; words are worked on ``most`` at a time."""
    o, flat = common.split_words(texts)
    codes, distinct = common.coded(flat)
    words = common.hash_strings(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    if len(words) <= most:
        return _segments(o, words, window, gram)
    # pieces of texts that overlap by a window less a word hold each window once; a segment cut in two is two segments
    out, step = [], max(most // 2 - window + 1, 1)
    for row, (i, j) in enumerate(zip(o[:-1].tolist(), o[1:].tolist())):
        for at in range(i, max(j - window + 1, i), step):
            own = words[at : min(at + step + window - 1, j)]
            _, start, *rest = _segments(np.array([0, len(own)]), own, window, gram)
            out.append((np.full(len(start), row), start + at - i, *rest))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 5


def _segments(o: np.ndarray, words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """As segments(), of texts whose words' hashes start at o; at most ``MOST`` words, as keys hold places in 24 bits."""
    n, size = len(words), np.diff(o)
    count = np.maximum(size - window + 1, 0)
    if not count.sum():
        return (np.zeros(0, np.int64),) * 5
    grams = np.zeros(n, np.uint64)
    for j in range(gram):
        grams[: n - j] = common.mix(grams[: n - j] * B + words[j:])
    wide = window - gram + 1
    key = (grams & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    low, span = key.copy(), 1
    while 2 * span <= wide:
        low[: n - span] = np.minimum(low[: n - span], low[span:])
        span *= 2
    at = common.gather(o[:-1], count)  # where each window starts
    least = (np.minimum(low[at], low[at + wide - span]) & np.uint64(0xFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(size)), count)
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    number = np.diff(np.append(first, len(at)))
    start, end = at[first], at[first] + number + window - 1
    base = np.uint64(0xD1B54A32D192ED03 | 1)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers(n, base), dtype=np.uint64)))
    content = common.mix((total[end] - total[start]) * _powers(n, inverse)[start] + number.astype(np.uint64))
    return row[first], start - o[:-1][row[first]], number, grams[least[first]].view(np.int64), content.view(np.int64)


def occurrences(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, mark (of the text), start, number, anchor, content of every segment of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.lean(batches):
            row, start, number, anchor, content = segments(common.strings(b["text"]), window, gram)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].take(at), b["mark"].take(at), *(pa.array(x.astype(np.int32)) for x in (start, number)), pa.array(anchor), pa.array(content)], ["doc_id", "mark", "start", "number", "anchor", "content"]
            )

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, mark int, start int, number int, anchor long, content long")


def cut(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """anchor, content, number, owner, words: the texts of the wanted segments."""
    lists = wanted.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "number", "anchor", "content", "parts")).alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.lean(batches):
            o, flat = common.split_words(common.strings(b["text"]))
            at, data = common.buffers(flat)
            of = b["of"].flatten()
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b["of"]).to_numpy(zero_copy_only=False))
            start = o[row] + of.field("start").to_numpy()
            size = of.field("number").to_numpy().astype(np.int64) + window - 1
            word = common.gather(start, size)
            width = at[word + 1] - at[word] + 1
            ends = np.concatenate(([0], np.cumsum(width)))
            letters = np.full(ends[-1], 32, np.uint8)
            letters[common.gather(ends[:-1], width - 1)] = data[common.gather(at[word], width - 1)]
            cuts = np.concatenate(([0], np.cumsum(size)))
            words = common.string_array(letters, ends[cuts])
            yield pa.RecordBatch.from_arrays([of.field("anchor"), of.field("content"), of.field("number"), of.field("parts"), b["doc_id"].take(pa.array(row)), words.cast(pa.string())], ["anchor", "content", "number", "parts", "owner", "words"])

    return docs.join(lists, ["doc_id", "mark"]).select("doc_id", "text", "of").mapInArrow(run, "anchor long, content long, number int, parts int, owner long, words string")


class Shard:
    """An FM-index over segments (rows of anchor, content, number, owner, words)."""

    def __init__(self, rows: pa.Table, window: int):
        self.window = window
        offsets, words = common.split_words(common.strings(rows["words"]))
        codes, self.names = common.coded(words)
        self.index = FMIndex(codes + 1, offsets, rows["owner"].to_numpy(), window, len(self.names) + 1)

    def search(self, rows: pa.Table) -> pa.RecordBatch:
        """anchor, content, number, runs of the rows; words that the index does not hold are 0."""
        offsets, words = common.split_words(common.strings(rows["words"]))
        codes, distinct = common.coded(words)
        known = pc.index_in(distinct, value_set=self.names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        least = self.index.matches(known[codes], offsets, MISSING)
        count = np.diff(offsets) - self.window + 1
        row = np.repeat(np.arange(len(count)), count)
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(least)))
        begin = first - (np.cumsum(count) - count)[row[first]]
        good = least[first] != MISSING
        first, length, begin = first[good], length[good], begin[good]
        runs = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array((begin + length).astype(np.int32)), pa.array(least[first])], ["first", "end", "owner"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(len(count) + 1)).astype(np.int32)), runs)
        return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks() for c in ("anchor", "content", "number")), lists], ["anchor", "content", "number", "runs"])


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by (anchor, part, slice), those of the part's own first, in tables, and whether a table begins a new index.

    A table that begins one holds whole groups, or all own rows of a group of more than ``size`` and some of its others; tables that
    follow it without beginning one hold others of that group.
    """
    held, n, last, streamed = [], 0, None, False  # last: the group of the last row; streamed: its index is made

    def key(b: pa.RecordBatch, i: int) -> tuple:
        return b["anchor"][i].as_py(), b["part"][i].as_py(), b["slice"][i].as_py()

    for b in batches:
        if not b.num_rows:
            continue
        a, p, s = (b[c].to_numpy() for c in ("anchor", "part", "slice"))
        cuts = np.concatenate(([0], np.flatnonzero((a[1:] != a[:-1]) | (p[1:] != p[:-1]) | (s[1:] != s[:-1])) + 1, [b.num_rows]))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows = b.slice(i, j - i)
            if key(rows, 0) != last:
                if n >= size and not streamed:
                    yield pa.Table.from_batches(held), True
                    held, n = [], 0
                last, streamed, begun = key(rows, 0), False, n
            if streamed:
                yield pa.Table.from_batches([rows]), False
                continue
            held.append(rows)
            n += rows.num_rows
            if n - begun >= size and not rows["own"][rows.num_rows - 1].as_py():  # all own rows have come
                yield pa.Table.from_batches(held), True
                held, n, streamed = [], 0, True
    if held:
        yield pa.Table.from_batches(held), True


def searched(texts: DataFrame, shards: int, window: int) -> DataFrame:
    """anchor, content, number, runs (first window, end, least owner): the segments streamed through the shards' indexes.

    A segment goes to its own part of the index in every slice, and in its own slice is asked of every part.
    """
    mine, every = F.pmod(F.xxhash64("content"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    pair = lambda p, s: F.struct(p.alias("part"), s.alias("slice"))
    groups = F.array_union(F.transform(every, lambda s: pair(mine, s)), F.transform(every, lambda p: pair(p, mine)))
    rows = texts.withColumn("group", F.explode(groups)).withColumns({"part": F.col("group.part"), "slice": F.col("group.slice")})
    rows = rows.withColumns({"own": F.col("part") == mine, "asked": F.col("slice") == mine})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for t, new in blocks(common.lean(batches), SHARD):
            if new:  # different anchors have no window in common, so groups can share an index
                shard = None
                shard = Shard(t.filter(t["own"]), window)
            t = t.filter(t["asked"])
            for i in range(0, t.num_rows, SHARD):
                yield shard.search(t.slice(i, SHARD).combine_chunks())

    dealt = rows.repartition(shards, "anchor", "part", "slice").sortWithinPartitions("anchor", "part", "slice", F.desc("own"))
    dealt = dealt.select("anchor", "content", "number", "part", "slice", "own", "asked", "owner", "words")
    return dealt.mapInArrow(run, "anchor long, content long, number int, runs array<struct<first:int,end:int,owner:long>>")


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, mark, spans (start, end in words) that documents with smaller ids hold too; docs: doc_id, mark, text."""
    spark = docs.sparkSession
    found = common.table(occurrences(docs, window, min(gram, window)), "segments")
    twice = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("rows")).where("low < high")
    hot = twice.where(common.is_hot("rows", found.count()))
    every, found = found, common.table(common.salted_join(found, twice.select("anchor"), ["anchor"], hot, "doc_id"), "candidates")
    common.drop_table(every)
    common.release(spark)
    total = found.count()
    once = found.groupBy("anchor", "content", "number").agg(F.min(F.struct("doc_id", "mark", "start")).alias("at"), F.count("*").alias("rows"))
    parts = once.groupBy("anchor").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"), F.count("*").alias("different"))
    hot = parts.where(common.is_hot("different", total))
    once = common.table(common.salted_join(once, parts.drop("different"), ["anchor"], hot, "content").select("anchor", "content", "number", "parts", "rows", "at.*"), "distinct")
    shards = max(1, -(-(once.agg(F.sum(2 * F.col("parts") - 1)).first()[0] or 0) // SHARD))
    results = common.table(searched(cut(docs, once, window), shards, window), "matches")
    common.release(spark)
    keys = ["anchor", "content", "number"]
    runs = results.select(*keys, F.explode("runs").alias("run"))
    spans = common.salted_join(found, runs, keys, once.where(common.is_hot("rows", total)), "doc_id").where("run.owner < doc_id")
    return spans.select("doc_id", "mark", (F.col("start") + F.col("run.first")).alias("start"), (F.col("start") + F.col("run.end") + window - 1).alias("end"))


def removal(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """The input (doc_id, text and more) with n_words, n_removed and kept: the kept words, or with texts=False their sha256."""
    rows = docs.withColumn("mark", F.hash("text"))
    keyed = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "mark", "text")
    spans = repeated(keyed, window).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = rows.join(spans.withColumnRenamed("doc_id", "__id"), (F.col("doc_id") == F.col("__id")) & (rows["mark"] == spans["mark"]), "left").select(*(rows[c] for c in docs.columns), "spans")

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.lean(batches):
            o, flat = common.split_words(common.strings(b["text"]))
            at, data = common.buffers(flat)
            n = len(flat)
            lists = b["spans"]
            of = lists.flatten()
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, o[row] + of.field("start").to_numpy(), 1)
            np.add.at(change, o[row] + of.field("end").to_numpy(), -1)
            kept = np.cumsum(change[:-1]) == 0
            removed = common.segment_sum((~kept).astype(np.int64), o)
            word = np.flatnonzero(kept)
            size = at[word + 1] - at[word] + 1
            ends = np.concatenate(([0], np.cumsum(size)))
            out = np.full(ends[-1], 32, np.uint8)
            out[common.gather(ends[:-1], size - 1)] = data[common.gather(at[word], size - 1)]
            cuts = ends[np.searchsorted(word, o)]
            raw = out.tobytes()
            pieces = [raw[i : max(j - 1, i)] for i, j in zip(cuts[:-1], cuts[1:])]
            last = pa.array([p.decode() for p in pieces] if texts else [hashlib.sha256(p).hexdigest() for p in pieces], pa.string())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(np.diff(o)), pa.array(removed), last], [*names, "n_words", "n_removed", "kept"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, f"{kinds}, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removal(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts lose the passages that a document with a smaller id holds too; n_chars follows."""
    common.small_batches(spark)
    out = removal(docs.withColumnsRenamed({c: f"d_{c}" for c in docs.columns if c not in ("doc_id", "text")}), texts=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    own = {"doc_id": F.col("doc_id"), "text": text} | ({"n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("d_n_chars"))} if "n_chars" in docs.columns else {})
    return out.select(*((own[c] if c in own else F.col(f"d_{c}")).alias(c) for c in docs.columns))
