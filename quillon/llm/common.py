"""Pieces that several operators share: folds, shared tables, vectorised word splitting and hashing."""

from __future__ import annotations

import ctypes
import functools
import json
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: What separates words: space and the ASCII controls from tab to carriage return.
SPACES = "[\\x20\\x09-\\x0D]"
MASK = (1 << 64) - 1
#: A key that holds more than one row of so many is hot, so that fewer keys than this can be; parts that its rows are dealt to.
HOT, SALTS = 1000, 64


def fold(key: Column | str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def words(text: Column | str) -> Column:
    """Words of a text (null: none) as an array, unchanged."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACES}+"), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode without one, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="quillon-")
    return f"file://{shared_dir.own}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of what table() returned."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_hot(rows: Column | str, total: int) -> Column:
    """Whether a key with this number of rows, of total, is hot."""
    return (F.col(rows) if isinstance(rows, str) else rows) * HOT > total


def salted_join(rows: DataFrame, said: DataFrame, keys: list[str], hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """rows joined by keys to said; rows of the keys in ``hot``, fewer than ``HOT`` by is_hot(), are dealt to ``SALTS`` parts by a
    hash of ``by``, in each of which said's rows for them stand."""
    marks = F.broadcast(hot.select(*keys, F.lit(SALTS).alias("salts")))
    salt = F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.lit(SALTS))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    left = rows.join(marks, keys, "left").withColumn("salt", salt).drop("salts")
    right = said.join(marks, keys, "left").withColumn("salt", every).drop("salts")
    return left.join(right, [*keys, "salt"], how).drop("salt")


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and about 8 MB, so that a Python worker's memory stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8388608")


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table; small ones of few files are dealt out to all cores."""
    from quillon.sources.records import spread

    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def broadcast_value(spark: SparkSession, value):
    return spark.sparkContext.broadcast(value)


def lean(batches):
    """The batches; memory of one goes back to the system before the next comes."""
    pa.set_memory_pool(pa.system_memory_pool())
    for b in batches:
        yield b
        del b
        trim()


def trim() -> None:
    """Gives memory that is free back to the system, where the C library can."""
    if own := getattr(ctypes.CDLL(None), "malloc_trim", None):
        own(0)


# --- vectorised text handling in Arrow batches -------------------------------------------------------------------


def strings(column) -> pa.Array:
    """A text column of a batch as one StringArray without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0, and the bytes of a StringArray."""
    n = len(texts)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o - o[0], b[o[0] : o[-1]]


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Words of all texts in one StringArray and, for each text, where its words start (n + 1 offsets).

    ``lower`` turns A-Z, and nothing else, to lower case.
    """
    o, b = buffers(texts)
    if lower:
        b = b + np.where((b >= 65) & (b <= 90), np.uint8(32), np.uint8(0))
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at = o[:-1][o[:-1] < len(b)]
    start[at] = inside[at]  # a text's first byte starts a word of its own
    first = np.flatnonzero(start)
    kept = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
    ends = np.append(kept[first], kept[-1]).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(b[inside])))
    return np.searchsorted(first, o).astype(np.int64), flat


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit (a bijection)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_strings(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string: the sum of a random value for each byte at its place, finalised with the length."""
    o, b = buffers(values)
    if not len(values):
        return np.zeros(0, np.uint64)
    size = np.diff(o)
    place = np.arange(len(b), dtype=np.int64) - np.repeat(o[:-1], size)
    each = mix((place.astype(np.uint64) << np.uint64(8)) + b + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)))
    return mix(total[o[1:]] - total[o[:-1]] + size.astype(np.uint64))


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes into the distinct values, and these."""
    if not len(flat):
        return np.zeros(0, np.int64), flat
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each range, one after the other."""
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - sizes), sizes)


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]], empty ranges 0, along the first axis."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)))
    return total[offsets[1:]] - total[offsets[:-1]]


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


@functools.lru_cache(maxsize=4)
def tokenizer(path: str, plain: bool = False):
    """The public tokenizer, loaded once by each worker process; plain: without its normaliser."""
    from tokenizers import Tokenizer, normalizers

    own = Tokenizer.from_file(path)
    own.no_padding()
    own.no_truncation()
    if plain:
        own.normalizer = normalizers.Sequence([])
    return own


@functools.lru_cache(maxsize=4)
def word_encoder(path: str, plain: bool = False) -> WordEncoder:
    """The worker process's own store of encoded words."""
    return WordEncoder(path, plain)


class WordEncoder:
    """Ids of words by a public tokenizer; each word that is new to this process is encoded once.

    At most ``limit`` words are held; after that the store starts anew, so memory stays bounded. A tokenizer that marks
    the ends of words encodes many words, none with white space in it, as one text.
    """

    def __init__(self, path: str, plain: bool = False, limit: int = 150_000):
        self.tokenizer = tokenizer(path, plain)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        mark = model.get("end_of_word_suffix")
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool) if mark else None
        for w, i in model["vocab"].items() if mark else ():
            self.ends[i] = w.endswith(mark)
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.sizes, self.flat = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of the words."""
        if self.ends is None:
            ids = [e.ids for e in self.batch(words, add_special_tokens=False)]
            return np.fromiter(map(len, ids), np.int32, len(ids)), np.fromiter((i for x in ids for i in x), np.uint32)
        own = self.batch([" ".join(words[i : i + 128]) for i in range(0, len(words), 128)], add_special_tokens=False)
        flat = np.concatenate([np.asarray(e.ids, np.uint32) for e in own])
        last = np.flatnonzero(self.ends[flat])
        return np.diff(last, prepend=-1).astype(np.int32), flat

    def __call__(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each value the start and size of its ids, and the ids of all."""
        own = values.to_pylist()
        if len(self.rows) + len(own) > self.limit:
            self.clear()
        rows = self.rows
        new = [w for w in own if w not in rows]
        if new:
            sizes, flat = self.encode(new)
            rows.update(zip(new, range(len(rows), len(rows) + len(new))))
            self.sizes, self.flat = np.append(self.sizes, sizes), np.append(self.flat, flat)
        at = np.fromiter(map(rows.__getitem__, own), np.int64, len(own))
        starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        return starts[at], self.sizes[at], self.flat


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
