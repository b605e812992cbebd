"""Exact top-k by inner product in three phases with a uniform threshold.

A vector's components form ``LISTS`` score lists: a row's score for a query is the sum of its partial scores in them.

1. Every task gathers, for each query and list, its rows with the best partial scores, and reports the best full scores
   among these. The k-th best of all reports is a lower bound of the k-th best score.
2. That bound is broadcast as a safe cutoff: a row that reaches it reaches a ``LISTS``-th part of it in some list. Each
   task collects the rows that do.
3. The remaining scores of those rows are resolved exactly, each task passes on at most its k best, and these are merged.

Queries are taken in blocks of at most ``BLOCK``, one after the other: each block meets all rows, its results are written and
its broadcasts destroyed before the next, so what is broadcast is bounded.

Defined results: rows with a null id, and vectors null or with null or non-finite components, take no part. Vectors of
different lengths are filled up with zeros. Rows that share the query's id count as its own; query rows that repeat an id
are queries of their own. Ties go to the smaller id; repeated rows of other ids each count. Scores beyond a long are held to
its range (and tie there). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import common

LISTS = 2
BLOCK = 4096
#: Queries of a block that are scored at a time against a batch.
STRIP = 256
SCALE = 64
#: The largest double, for a finite component whose multiple is none.
MOST = np.finfo(np.float64).max


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)


def whole(lists: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of each component, filled up with zeros, or cut, to ``width``."""
    o = lists.offsets.to_numpy().astype(np.int64)
    with np.errstate(over="ignore"):
        flat = np.floor(SCALE * lists.values.slice(o[0], o[-1] - o[0]).to_numpy(zero_copy_only=False)) + 0.0
    flat = np.clip(flat, -MOST, MOST)
    size, o = np.diff(o), o - o[0]
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    each = np.minimum(size, width)
    rows = np.repeat(np.arange(len(size)), each)
    out[rows, common.gather(np.zeros(len(size), np.int64), each)] = flat[common.gather(o[:-1], each)]
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers, of sums below 2^62: in floating point where every sum is exact there."""
    bound = a.shape[1] * (np.abs(a).max(initial=0) * np.abs(b).max(initial=0))
    if bound < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _long(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T by whole numbers of any size, held to the range of a long."""
    as_int = np.vectorize(int, otypes=[object])
    return np.clip(as_int(a) @ as_int(b).T, LOW + 1, -(LOW + 1)).astype(np.int64) if a.size and b.size else np.zeros((len(a), len(b)), np.int64)


def _cuts(width: int) -> list[tuple[int, int]]:
    """Where each list's components begin and end."""
    cuts = np.linspace(0, width, LISTS + 1).astype(int).tolist()
    return list(zip(cuts[:-1], cuts[1:]))


def _partial(q: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """Partial scores in each list. Where sums could leave a long, the first list holds the whole score and the others none."""
    if not _small(q, v):
        whole_score = _long(q, v)
        return [whole_score, *(np.zeros_like(whole_score) for _ in range(LISTS - 1))]
    return [_exact(q[:, i:j], v[:, i:j]) for i, j in _cuts(q.shape[1])]


def _small(q: np.ndarray, v: np.ndarray) -> bool:
    with np.errstate(over="ignore"):
        return q.shape[1] * (np.abs(q).max(initial=0) * np.abs(v).max(initial=0)) < 2**62


def collected(q: np.ndarray, v: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
    """Query, row and score of all that reach the cutoff ``low`` (one for each query).

    Lists are resolved one after the other, and a row goes on to the next only while, by the norms of the components that are
    left, it can still reach the cutoff of some query; such a row is collected where a list holds its LISTS-th part.
    """
    if not _small(q, v):
        parts, cols = _partial(q, v), np.arange(len(v))
    else:
        cuts, cols, parts = _cuts(q.shape[1]), np.arange(len(v)), []
        norms = [(np.sqrt((q[:, i:j] ** 2).sum(axis=1)), np.sqrt((v[:, i:j] ** 2).sum(axis=1))) for i, j in cuts]
        total = np.zeros((len(q), len(v)))
        for n, (i, j) in enumerate(cuts):
            parts.append(_exact(q[:, i:j], v[cols, i:j]))
            total = total + parts[-1]
            rest = sum(a[:, None] * b[None, cols] for a, b in norms[n + 1 :])
            able = total + rest + 1 + 1e-9 * (np.abs(total) + rest) >= low[:, None] - 1e-9 * np.abs(low[:, None].astype(float))
            stay = able.any(axis=0)
            if not stay.all():
                cols, parts, total = cols[stay], [p[:, stay] for p in parts], total[:, stay]
    some = reduce(np.logical_or, (p >= low[:, None] // LISTS for p in parts))
    i, j = np.nonzero(some)
    score = reduce(np.add, (p[i, j] for p in parts))
    good = score >= low[i]
    return i[good], cols[j[good]], score[good]


LOW = np.iinfo(np.int64).min


def _reports(rows: DataFrame, sent, k: int) -> DataFrame:
    """Phase 1: q (place in the block), scores: a task's best full scores among its best partial ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        best = np.full((len(ids), k), LOW)
        for b in batches:
            if not b.num_rows:
                continue
            own, v = b["id"].to_numpy(), whole(b["v"], q.shape[1])
            for s in range(0, len(ids), STRIP):
                parts = _partial(q[s : s + STRIP], v)
                total = reduce(np.add, parts)
                total[own[None, :] == ids[s : s + STRIP, None]] = LOW
                n = min(k, len(own))
                seen = np.concatenate([np.argpartition(p, len(own) - n, axis=1)[:, len(own) - n :] for p in parts], axis=1)
                seen.sort(axis=1)
                found = np.take_along_axis(total, seen, axis=1)
                found[:, 1:][seen[:, 1:] == seen[:, :-1]] = LOW  # a row in two lists is one row
                both = np.concatenate((best[s : s + STRIP], found), axis=1)
                best[s : s + STRIP] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids), dtype=np.int32)), pa.array([x[x > LOW] for x in best], pa.list_(pa.int64()))], ["q", "scores"])

    return rows.mapInArrow(run, "q int, scores array<long>")


def _best(q: np.ndarray, own: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, ties to the smaller id."""
    order = np.lexsort((own, -score, q))
    start = np.searchsorted(q[order], q[order])
    return order[np.arange(len(order)) - start < k]


def _entries(rows: DataFrame, sent, cutoffs, k: int) -> DataFrame:
    """Phases 2 and 3: q, query_id, vec_id, score: a task's best rows that reach the cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        cut = cutoffs.value
        held = [np.zeros(0, np.int64)] * 3
        for b in batches:
            if not b.num_rows:
                continue
            own, v = b["id"].to_numpy(), whole(b["v"], q.shape[1])
            for s in range(0, len(ids), STRIP):
                i, j, score = collected(q[s : s + STRIP], v, cut[s : s + STRIP])
                other = own[j] != ids[s + i]
                held = [np.concatenate(x) for x in zip(held, (i[other] + s, own[j[other]], score[other]))]
            if len(held[0]) > 2 * k * len(ids) + 50_000:
                at = _best(*held, k)
                held = [x[at] for x in held]
        at = _best(*held, k)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held[0][at], ids[held[0][at]], held[1][at], held[2][at])], ["q", "query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "q long, query_id long, vec_id long, score long")


def _block(vectors: DataFrame, own: pa.Table, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of a block's queries, written; nothing of the block stays in memory."""
    spark = vectors.sparkSession
    ids, lists = own["id"].combine_chunks().to_numpy(), own["v"].combine_chunks()
    width = int(np.diff(lists.offsets.to_numpy()).max(initial=1))
    sent = common.broadcast_value(spark, (ids, whole(lists, max(width, 1))))
    ranked = _reports(vectors, sent, k).select("q", F.explode("scores").alias("score"))
    ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(f"n <= {k}")
    low = ranked.groupBy("q").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(f"n = {k}").toArrow()
    cut = np.full(len(ids), LOW)
    cut[low["q"].to_numpy()] = low["low"].to_numpy()
    cut = common.broadcast_value(spark, cut)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = _entries(vectors, sent, cut, k).withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
    out = common.table(best.select("query_id", "rank", "vec_id", "score"), "block")
    for x in (sent, cut):
        x.destroy()
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score; vectors and queries: id, v as usable() gives them."""
    blocks = -(-max(queries.count(), 1) // (BLOCK // 2))
    part = F.pmod(F.xxhash64("id"), F.lit(blocks))
    found = []
    for n in range(blocks):
        t = queries.where(part == n).orderBy("id").toArrow()
        for s in range(0, t.num_rows, BLOCK):
            found.append(_block(vectors, t.slice(s, BLOCK).combine_chunks(), k))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, found)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(common.documents(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where("id % 20 = 0"), 20)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
