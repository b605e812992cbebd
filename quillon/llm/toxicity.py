"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; everything else is unlabelled text, which holds toxic texts too, in the share
of the class prior. A linear numpy classifier is fitted to the class-prior-corrected risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

whose second part, the risk on negatives, cannot be negative; where a step would push it below zero the step is turned
round. Features are hashed words and word beginnings: that a text holds one, two or three distinct words of a bucket.

Fitting uses at most ``MOST_POSITIVE`` and about ``MOST_UNLABELLED`` rows, chosen by a hash of doc_id; scoring covers all rows.

Defined results: empty and null texts get the intercept's score; without positives every score is 0. Repeated rows get
equal scores; label rows without a document, or with a null id or mark, teach nothing; other columns are ignored. An
empty table gives no rows; texts of any length are read whole. predict() replaces input columns of its outputs' names;
the stage leaves such columns as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common
from quillon.llm.langid import letter_words

BITS = 20
#: So many distinct words of a bucket are told apart; each number has a range of features of its own.
LEVELS = 3
WIDTH = LEVELS << BITS
BEGINNINGS = (4, 5, 6, 7)
MOST_POSITIVE = 2048
MOST_UNLABELLED = 8192
#: Features in fewer positives than this, or no likelier there by this many standard errors, are left out.
LEAST_POSITIVE, LEAST_Z = 4, 6.0
#: RIDGE and LEAST_Z are the best of eight pairs on one training fold of sf0.1, fitted on the other training folds.
STEPS, RATE, RIDGE = 300, 0.05, 3e-2
FOLDS = 5


def word_features(values: pa.Array) -> np.ndarray:
    """For each word the buckets of the word and of its beginnings (-1 where it is no longer than them)."""
    own = values.to_pylist()
    points = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(points)) - np.repeat(starts, sizes)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(common.mix((points << np.uint64(16)) + place.astype(np.uint64)), dtype=np.uint64)))
    out = np.full((len(own), 1 + len(BEGINNINGS)), -1, np.int64)
    for k, n in enumerate((None, *BEGINNINGS)):
        rows = np.arange(len(own)) if n is None else np.flatnonzero(sizes > n)
        end = starts[rows] + (sizes[rows] if n is None else n)
        h = common.mix(total[end] - total[starts[rows]] + np.uint64(n or 0))
        out[rows, k] = (h >> np.uint64(64 - BITS)).astype(np.int64)
    return out


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each text's distinct words start, their codes, and the words."""
    o, flat = letter_words(texts)
    codes, distinct = common.coded(flat)
    of = np.repeat(np.arange(len(texts)), np.diff(o))
    pairs = np.unique(of * max(len(distinct), 1) + codes)
    return np.searchsorted(pairs, np.arange(len(texts) + 1) * max(len(distinct), 1)), pairs % max(len(distinct), 1), distinct


def levelled(rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every row's buckets (those of -1 left out), each once, in order of rows for each level."""
    some = buckets >= 0
    pairs, n = np.unique((rows[some] << BITS) + buckets[some], return_counts=True)
    each = [pairs[n > k] for k in range(LEVELS)]
    return np.concatenate([x >> BITS for x in each]), np.concatenate([(x & ((1 << BITS) - 1)) + (k << BITS) for k, x in enumerate(each)])


def features(texts: pa.Array) -> list[np.ndarray]:
    """Features of each text."""
    at, codes, distinct = distinct_words(texts)
    each = word_features(distinct)[codes] if len(codes) else np.zeros((0, 1), np.int64)
    row, feature = levelled(np.repeat(np.repeat(np.arange(len(texts)), np.diff(at)), each.shape[1]), each.ravel())
    order = np.argsort(row, kind="stable")
    return np.split(feature[order].astype(np.int32), np.searchsorted(row[order], np.arange(1, len(texts))))


def select(rows: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    """Features that mark positives clearly, in order."""
    n_pos, n_unl = max(positive.sum(), 1), max((~positive).sum(), 1)
    df = np.zeros((2, WIDTH), np.int32)
    for r, p in zip(rows, positive):
        df[0 if p else 1, r] += 1  # a row has each of its features once
    some = np.flatnonzero(df[0] >= LEAST_POSITIVE)
    x, y = df[0, some], df[1, some]
    both = (x + y + 1) / (n_pos + n_unl + 2)
    z = (x / n_pos - y / n_unl) / np.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_unl))
    return some[z >= LEAST_Z]


def nn_pu(rows: list[np.ndarray], positive: np.ndarray, prior: float, chosen: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the chosen features and the intercept, by Adam on the non-negative risk with logistic loss."""
    place = np.full(WIDTH, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    cut = [place[r] for r in rows]
    cut = [c[c >= 0] for c in cut]
    of = np.repeat(np.arange(len(rows)), [len(c) for c in cut])
    cols = np.concatenate(cut).astype(np.int64) if cut else np.zeros(0, np.int64)
    n_pos, n_unl = positive.sum(), (~positive).sum()
    w = np.zeros(len(chosen) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        s = np.bincount(of, w[cols], len(rows)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
        soft = np.logaddexp(0, s)  # loss(-); its slope is p
        risk = soft[~positive].mean() - prior * soft[positive].mean()
        negative = np.where(positive, -prior * p / n_pos, p / n_unl)
        pull = np.where(positive, -prior * (1 - p) / n_pos, 0.0)
        g = pull + negative if risk >= 0 else -negative
        step = np.append(np.bincount(cols, g[of], len(chosen)), g.sum()) + RIDGE * np.append(w[:-1], 0) * prior
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step**2
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], w[-1]


class Model(NamedTuple):
    """Features that have a weight, in order; their weights; the intercept."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float


NOTHING = Model(np.zeros(0, np.int64), np.zeros(0), -40.0)


def learned(sample: DataFrame, prior: float) -> Model:
    """The model of a bounded sample (text, positive), fitted in one task of an executor; the driver gets its weights only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[bytes, bool], np.ndarray] = {}  # a text that was copied counts once
        for b in common.lean(batches):
            for r, p in zip(features(common.strings(b["text"])), b["positive"].to_pylist()):
                found[hashlib.blake2b(r.tobytes(), digest_size=16).digest(), p] = r
        keys = sorted(found)  # whatever order the rows come in
        rows, positive = [found[k] for k in keys], np.array([p for _, p in keys], bool)
        if positive.any() and not positive.all():
            chosen = select(rows, positive)
            w, bias = nn_pu(rows, positive, prior, chosen)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(chosen, -1)), pa.array(np.append(w, bias))], ["feature", "weight"])

    t = sample.repartition(1).mapInArrow(run, "feature long, weight double").toArrow()
    if not t.num_rows:
        return NOTHING
    f, w = t["feature"].to_numpy(), t["weight"].to_numpy()
    return Model(f[f >= 0], w[f >= 0], float(w[f < 0][0]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model; learns from rows outside the held-out fold."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(common.fold("doc_id", FOLDS) != 0)
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    ids = known.where("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_POSITIVE)
    ids = [r[0] for r in ids.collect()]
    if not ids:
        return NOTHING
    spark = docs.sparkSession
    open_ = docs.where(F.col("doc_id").isNotNull() & (common.fold("doc_id", FOLDS) != 0)).select("doc_id", "text")
    chosen = spark.createDataFrame([(i, True) for i in ids], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, positive boolean")
    rate = min(1.0, MOST_UNLABELLED / max(open_.count(), 1))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1_000_003)) < int(rate * 1_000_003) + (rate >= 1)
    sample = open_.join(F.broadcast(chosen), "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False))).where(drawn | F.col("positive"))
    return learned(sample.select("text", "positive"), min(max(share, 1e-3), 0.5))


def predict(docs: DataFrame, model: Model, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The input with the score and the prediction, in columns named by ``out``."""
    sent = common.broadcast_value(docs.sparkSession, tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        w = np.zeros(WIDTH)
        w[model.chosen] = model.weights
        weighty = np.zeros(1 << BITS, bool)
        weighty[model.chosen & ((1 << BITS) - 1)] = True
        for b in common.lean(batches):
            at, codes, distinct = distinct_words(common.strings(b["text"]))
            total = np.full(b.num_rows, model.bias)
            if len(codes):
                f = word_features(distinct)
                marks = np.flatnonzero((weighty[f] & (f >= 0)).any(axis=1))  # few words carry any weight
                hit = np.flatnonzero(np.isin(codes, marks))
                of = np.searchsorted(at, hit, side="right") - 1
                each = f[codes[hit]]
                row, feature = levelled(np.repeat(of, each.shape[1]), each.ravel())
                total += np.bincount(row, w[feature], b.num_rows)
            p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*b.schema.names, *out])

    own = docs.drop(*out)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(run, f"{kinds}, `{out[0]}` double, `{out[1]}` int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit(docs, common.documents(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", (common.fold("doc_id", FOLDS) == 0).alias("held_out"))
    return predict(rows, model).drop("text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of 0.5 or more go."""
    common.small_batches(spark)
    model = fit(docs, common.documents(spark, sf_dir, "labels"))
    out = common.fresh(docs, "score"), common.fresh(docs, "predicted")
    return predict(docs, model, out).where(F.col(out[1]) == 0).select(*docs.columns)
