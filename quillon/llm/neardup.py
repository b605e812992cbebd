"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has t coordinates. In round i every shingle falls into a bin chosen by hash and leaves a hash value there; a bin
keeps the smallest value of the first round that reached it. Rounds go on until every bin is filled; the rounds from t on
each serve one bin with all shingles, so that 2t rounds always fill it. Two sets agree in a coordinate with the
probability of their Jaccard similarity, with Chernoff-like concentration. The number of bands follows from the threshold so that a pair at the
threshold shares no band with probability of at most ``MISS``.

Texts with equal sets form one class, which its smallest id stands for; only classes are compared, so a large group of
copies costs no pairs. In each bucket of a band the smallest class is compared with the others (a star); confirmed
links join classes into components. Further rounds take another centre, while a bucket still holds several components.
What then is left, pairs of one bucket in different components, is compared exhaustively in tiles of a bucket, so no link
that changes a component is passed over: a pair that already is in one component needs no comparison. Tiles compare
``LONG`` coordinates of longer sketches, ``PLANES`` bits of each, and hand on, once for all buckets, the pairs that agree in as
many as a pair at the threshold does with a probability of all but ``MISS``; their full sets are compared.

Defined results: null or wordless texts have the empty set, are linked with nothing and are kept. Rows with a null id are
kept, with a null component, and link nothing. Rows that repeat an id are treated like any others: each is a node of its
own, whatever its text. An empty table gives no rows; a very long text is one row of a batch, and its set is held whole.
Other columns are ignored. Sets are compared by 64-bit hashes of their shingles.

Tables that are written on the way are dropped after their last reader; two small ones, which the result reads, stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common
from quillon.llm.components import components

ROWS = 5
MISS = 1e-9
#: Rounds of stars before what is left is compared exhaustively.
STARS = 3
#: Coordinates of the longer sketches, and the bits of each that are kept.
LONG, PLANES = 2048, 2
#: Classes of a tile's side.
TILE = 512
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def bands(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def least_agreement(percent: int, t: int, miss: float = MISS) -> int:
    """Coordinates that a pair at the threshold shares with a probability of at least 1 - miss."""
    q = percent / 100 + (1 - percent / 100) / 2**PLANES
    total, c = 0.0, 0
    while True:
        total += math.exp(math.lgamma(t + 1) - math.lgamma(c + 1) - math.lgamma(t - c + 1) + c * math.log(q) + (t - c) * math.log(1 - q))
        if total > miss:
            return c
        c += 1


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's set starts, and the sorted 64-bit hashes of its distinct shingles of k words.

    A text of fewer words has one shingle, the whole sequence.
    """
    o, flat = common.split_words(texts, lower=True)
    codes, distinct = common.coded(flat)
    words = common.hash_strings(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    size = np.diff(o)
    each = np.where(size >= k, size - k + 1, (size > 0).astype(np.int64))
    at = common.gather(o[:-1], each)
    of = np.repeat(np.arange(len(size)), each)
    last = o[1:][of]
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = at + j < last
        h = np.where(inside, common.mix(h * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(at + j, len(words) - 1)] + np.uint64(j)), h) if len(at) else h
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[first], of[first]
    return np.searchsorted(of, np.arange(len(size) + 1)), h


def sketches(at: np.ndarray, sets: np.ndarray, t: int) -> np.ndarray:
    """The sketch of each set, none of them empty: one row of t values."""
    n = len(at) - 1
    out = np.full(n * t, EMPTY)
    rows, elements, of = np.arange(n), sets, np.repeat(np.arange(n), np.diff(at))
    for i in range(2 * t):
        v = common.mix(elements + np.uint64(((i + 1) * 0xD1B54A32D192ED03) & common.MASK))
        place = of * t + ((v % np.uint64(t)).astype(np.int64) if i < t else i - t)
        value = (np.uint64(i) << np.uint64(52)) | (common.mix(v) >> np.uint64(12))
        free = out[place] == EMPTY
        place, value = place[free], value[free]
        order = np.lexsort((value, place))
        place, value = place[order], value[order]
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        out[place[first]] = value[first]
        rows = rows[(out.reshape(n, t)[rows] == EMPTY).any(axis=1)]
        if not len(rows):
            break
        size = np.diff(at)[rows]
        elements, of = sets[common.gather(at[rows], size)], np.repeat(rows, size)
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    n, t = sketch.shape
    parts = sketch.reshape(n, t // rows, rows)
    h = np.broadcast_to(np.arange(t // rows, dtype=np.uint64) + np.uint64(1), (n, t // rows)).copy()
    for j in range(rows):
        h = common.mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return h.view(np.int64)


def planes(sketch: np.ndarray) -> np.ndarray:
    """PLANES bits of each coordinate, plane after plane, each filled up to whole 64-bit numbers."""
    n, t = sketch.shape
    out = np.zeros((n, PLANES, -(-t // 64) * 64), np.uint8)
    for j in range(PLANES):
        out[:, j, :t] = sketch >> np.uint64(j) & np.uint64(1)
    return np.packbits(out, axis=2, bitorder="little").view(np.int64).reshape(n, -1)


def sketched(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """row (a number of its own), doc_id, mark (of the text), n (set size), a and b (128 bits that name the set), keys (of its bands)."""
    number = bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.lean(batches):
            at, sets = shingle_sets(common.strings(b["text"]), k)
            size = np.diff(at)
            one, two = (common.segment_sum(common.mix(sets + np.uint64(s)), at).view(np.int64) for s in (1, 2))
            full = np.flatnonzero(size)
            keys: list = [None] * len(size)
            if len(full):
                found = band_keys(sketches(np.append(at[full], at[-1]), sets, number * ROWS), ROWS)
                for row, x in zip(full, found):
                    keys[row] = x
            own = [b["doc_id"], b["mark"], pa.array(size.astype(np.int64)), pa.array(one), pa.array(two), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(own, ["doc_id", "mark", "n", "a", "b", "keys"])

    rows = marked(docs).mapInArrow(run, "doc_id long, mark long, n long, a long, b long, keys array<long>")
    return rows.withColumn("row", F.monotonically_increasing_id())


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, mark, text; rows that share an id have different marks if their texts differ."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (x, y) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.lean(batches):
            (p, s), (q, r) = (shingle_sets(common.strings(b[c]), k) for c in ("text_x", "text_y"))
            row = np.concatenate((np.repeat(np.arange(b.num_rows), np.diff(p)), np.repeat(np.arange(b.num_rows), np.diff(q))))
            h = np.concatenate((s, r))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
            both = np.bincount(row[1:][same], minlength=b.num_rows)
            linked = 100 * both >= percent * (np.diff(p) + np.diff(q) - both)
            yield b.select(["x", "y"]).filter(pa.array(linked))

    with_x = pairs.join(texts.select(F.col("id").alias("x"), F.col("text").alias("text_x")), "x")
    with_y = with_x.join(texts.select(F.col("id").alias("y"), F.col("text").alias("text_y")), "y")
    return with_y.select("x", "y", "text_x", "text_y").mapInArrow(run, "x long, y long")


def profiles(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """id, keys (of its bands), planes (of its longer sketch) of texts with words."""
    number = bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.lean(batches):
            for b in (whole.slice(i, 100) for i in range(0, whole.num_rows, 100)):
                at, sets = shingle_sets(common.strings(b["text"]), k)
                keys, bits = band_keys(sketches(at, sets, number * ROWS), ROWS), planes(sketches(at, sets, LONG))
                yield pa.RecordBatch.from_arrays([b["id"], *(pa.array(list(x), pa.list_(pa.int64())) for x in (keys, bits))], ["id", "keys", "planes"])

    return texts.select("id", "text").mapInArrow(run, "id long, keys array<long>, planes array<long>")


def tiled(left: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of one bucket and different components whose longer sketches agree enough; left: key, id, component;
    about: profiles() of their texts.

    In each bucket only pairs without the component that is largest there, or with one side of it, are looked at: the
    others are pairs within that component.
    """
    sizes = left.groupBy("key", "component").agg(F.count("*").alias("n"))
    mains = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("few"))
    rows = left.join(mains, "key")
    side = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    own = lambda n: F.pmod(F.xxhash64("id"), side(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), side(n) - 1))
    one = rows.where("component <> main").select("key", "id", "component", "main", F.lit(True).alias("small"), own("few").alias("s"), each("all").alias("t"))
    two = rows.select("key", "id", "component", "main", F.lit(False).alias("small"), own("all").alias("t"), each("few").alias("s"))
    most = LONG - least_agreement(percent, LONG)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        ids, component, small = (t[c].to_numpy() for c in ("id", "component", "small"))
        main = t["main"][0].as_py()
        keys, bits = (t[c].combine_chunks().flatten().to_numpy().reshape(len(ids), -1) for c in ("keys", "planes"))
        bits = bits.view(np.uint64).reshape(len(ids), PLANES, -1)
        others = np.flatnonzero(~small)
        x, y = [], []
        for i in np.flatnonzero(small):
            near = others[(component[others] != component[i]) & ((component[others] == main) | (ids[others] > ids[i]))]
            apart = np.bitwise_count(np.bitwise_or.reduce(bits[near] ^ bits[i], axis=1)).sum(axis=1, dtype=np.int64)
            near = near[apart <= most]
            if len(near):  # a pair is handed on by the least of the buckets that hold both
                shared = np.where(keys[near] == keys[i], keys[near], np.iinfo(np.int64).max).min(axis=1)
                near = near[shared == key[0].as_py()]
                x.append(np.full(len(near), ids[i]))
                y.append(ids[near])
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (x, y))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["x", "y"])

    return one.unionByName(two).join(about, "id").groupBy("key", "s", "t").applyInArrow(run, "x long, y long")


def linked(hits: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame | None:
    """id, component of all classes that confirmed links join (None: no link); hits: key, id of classes that share a bucket."""
    labels = hits.select("id").limit(0).select("id", F.col("id").alias("component"))
    checked, known = [], None
    for turn in range(STARS + 1):
        now = hits.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        mixed = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("any"), F.min("id").alias("least")).where("low < high")
        if turn < STARS:
            centre = F.col("least") if turn == 0 else F.col("any")
            centres = mixed.select("key", centre.alias("centre")).join(labels.withColumnRenamed("id", "centre").withColumnRenamed("component", "at"), "centre", "left")
            centres = centres.select("key", "centre", F.coalesce("at", "centre").alias("at"))
            met = now.join(centres, "key").where("component <> at").select(F.least("id", "centre").alias("x"), F.greatest("id", "centre").alias("y"))
        else:
            left = now.join(mixed.select("key"), "key", "left_semi")
            about = common.table(profiles(texts.join(left.select("id").distinct(), "id", "left_semi"), k, percent), "profiles")
            met = tiled(left, about, percent)
        pairs = met.distinct()
        if checked:
            pairs = pairs.join(reduce(DataFrame.unionByName, checked), ["x", "y"], "left_anti")
        pairs = common.table(pairs, "pairs")
        checked.append(pairs)
        if turn == STARS:
            common.drop_table(about)
        if pairs.isEmpty():
            continue
        links = common.table(confirmed(pairs, texts, k, percent), "links")
        if not links.isEmpty():  # a component that is known counts as the star of its least class
            stars = links if known is None else links.unionByName(known.select(F.col("component").alias("x"), F.col("id").alias("y")))
            known, before = common.table(components(stars), "labels"), known
            labels = known
            if before is not None:
                common.drop_table(before)
        common.drop_table(links)
        common.release(hits.sparkSession)
    for pairs in checked:
        common.drop_table(pairs)
    return known


def assigned(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, kept of every row."""
    rows = common.table(sketched(docs, k, percent), "sketches")
    named = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("a", "b", "n").agg(F.min("row").alias("id"), F.first("keys").alias("keys"))
    members = classes.select("id", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    hits = common.table(members.join(shared, "key").select("key", "id"), "buckets")
    common.release(docs.sparkSession)
    whose = rows.select(F.col("row").alias("id"), "doc_id", "mark").join(hits.select("id").distinct(), "id")
    texts = marked(docs).join(whose, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select("id", "text")
    texts = common.table(texts, "texts")
    common.release(docs.sparkSession)
    labels = linked(hits, texts, k, percent)
    for used in (hits, texts):
        common.drop_table(used)
    # what a class and its component need to say: the smallest doc_id
    least = named.groupBy("a", "b", "n").agg(F.min("row").alias("id"), F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    if labels is None:
        said = least.where("rows > 1").select("a", "b", "n", "rows", F.col("least").alias("component"))
    else:
        with_label = least.join(labels, "id", "left")
        lowest = with_label.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("lowest"))
        said = with_label.join(lowest, "component", "left").where("rows > 1 OR lowest IS NOT NULL").select("a", "b", "n", "rows", F.coalesce("lowest", "least").alias("component"))
    said = common.table(said.withColumn("hot", common.is_hot("rows", rows.count())).drop("rows"), "said")
    if labels is not None:
        common.drop_table(labels)
    out = common.salted_join(rows.select("row", "doc_id", "mark", "n", "a", "b"), said.drop("hot"), ["a", "b", "n"], said.where("hot"), "row", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return assigned(docs, k, percent).drop("mark")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.documents(spark, sf_dir).select("doc_id", "text"), k=3, percent=85)


def keep_one_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (five words, 0.8) the document with the smallest id stays.

    Rows without words or id stay, as do all rows of the id that stays if they are of its group.
    """
    common.small_batches(spark)
    name, mark = common.fresh(docs, "gone"), common.fresh(docs, "mark")
    gone = assigned(docs.select("doc_id", "text"), 5, 80).where(~F.col("kept")).select(F.col("doc_id").alias(name), F.col("mark").alias(mark)).distinct()
    of = (F.col("doc_id").cast("long") == F.col(name)) & (F.xxhash64("text") == F.col(mark))
    return docs.join(gone, of, "left_anti").select(*docs.columns)
