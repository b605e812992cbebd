"""Language identification as inference of a multilingual mixture.

Each learned language has a smoothed distribution over hashed character trigrams of its words. A document is a mixture:
every word is drawn from one of the languages, in unknown proportions. Expectation-maximisation estimates the
proportions from the words' trigram likelihoods; nested sets of languages are then compared by their likelihood less a
penalty for each further language, and the largest proportion of the chosen set is the prediction.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text when nothing could be
learned. Ties go to the language that sorts first. Repeated rows get equal results. Other columns are ignored; rows
with a null language or a null text teach nothing. An empty table gives no rows. A text of any length is inferred whole;
its words are held at once. predict() replaces input columns of its outputs' names; identify() and the stage don't read
such columns, and the stage leaves them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

BITS = 15
SMOOTHING = 0.5
ROUNDS = 6
#: Log-likelihood that a further language must gain, beside half the log of the number of words.
PENALTY = 3.0
#: Words that are worked on at a time.
CHUNK = 1 << 20


def letter_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lower-cased runs of letters of all texts and where each text's words start."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"\P{L}+")
    flat = lists.values
    o = lists.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate(([0], np.cumsum(full, dtype=np.int64)))
    return kept[o], flat.filter(pa.array(full))


def trigrams(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character trigrams of each word, with its ends marked, and where each word's start."""
    own = values.to_pylist()
    points = np.frombuffer(("\n" + "\n".join(own) + "\n\n").encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    at = common.gather(starts, sizes)
    h = common.mix(points[at] * np.uint64(0x9E3779B97F4A7C15) + points[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[at + 2] * np.uint64(0x165667B19E3779F9))
    return (h >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, bucket, n: trigram counts of all texts that have a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in common.lean(batches):
            o, flat = letter_words(common.strings(b["text"]))
            codes, distinct = common.coded(flat)
            if not len(codes):
                continue
            buckets, at = trigrams(distinct)
            langs, names = common.coded(common.strings(b["lang"]))
            of = np.repeat(langs, np.diff(o))
            for k, name in enumerate(names.to_pylist()):
                each = np.bincount(codes[of == k], minlength=len(distinct))
                total[name] = total.get(name, 0) + np.bincount(buckets, np.repeat(each, np.diff(at)), 1 << BITS)
        for name, x in total.items():
            full = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(x[full].astype(np.int64))], ["lang", "bucket", "n"])

    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    return known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and, for each bucket, the log-likelihood under each (bounded: 2^15 buckets a language)."""
    t = counts(docs).toArrow()
    langs = sorted(set(t["lang"].to_pylist()))
    n = np.zeros((1 << BITS, len(langs)))
    if langs:
        at = pc.index_in(t["lang"], value_set=pa.array(langs)).to_numpy()
        n[t["bucket"].to_numpy(), at] = t["n"].to_numpy()
    return langs, np.log((n + SMOOTHING) / (n.sum(axis=0) + SMOOTHING * (1 << BITS)))


def _expect(share: np.ndarray, like: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: new proportions of each document, and each document's log-likelihood under the old ones."""
    joint = like * np.repeat(share, sizes, axis=0)
    total = joint.sum(axis=1)
    joint /= total[:, None]
    return np.add.reduceat(joint, starts, axis=0) / sizes[:, None], np.add.reduceat(np.log(total.astype(np.float64)), starts)


def infer(codes: np.ndarray, sizes: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of documents of ``sizes`` words each (none empty); score: log-likelihoods of the distinct words."""
    starts = np.cumsum(sizes) - sizes
    top = score.max(axis=1, keepdims=True)
    like = np.maximum(np.exp(score - top), 1e-12).astype(np.float32)[codes]
    n_langs = score.shape[1]
    share = np.full((len(sizes), n_langs), 1 / n_langs, np.float32)
    for _ in range(ROUNDS):
        share, _ = _expect(share, like, starts, sizes)
        share = np.maximum(share, 1e-9)
    order = np.argsort(-share, axis=1, kind="stable")
    rows = np.arange(len(sizes))
    single = np.add.reduceat((score - top)[codes], starts, axis=0)
    best, kept = single.max(axis=1), np.zeros_like(share)
    lang = single.argmax(axis=1)
    kept[rows, lang] = 1
    for k in range(2, n_langs + 1):
        inside = np.zeros_like(share)
        inside[rows[:, None], order[:, :k]] = 1
        own = np.maximum(share * inside, 1e-12 * inside)
        own /= own.sum(axis=1, keepdims=True)
        own, _ = _expect(own, like, starts, sizes)
        _, total = _expect(own, like, starts, sizes)
        total = total - (k - 1) * (PENALTY + 0.5 * np.log(sizes))
        better = total > best
        best, kept = np.where(better, total, best), np.where(better[:, None], own, kept)
    lang = kept.argmax(axis=1)
    part = kept[rows, lang].astype(np.float64)
    if n_langs > 1:  # a short text's only language counts as far as it beats the next
        two = np.sort(single, axis=1)[:, -2:]
        part = np.where(part >= 1, 1 / (1 + np.exp(-np.minimum(two[:, 1] - two[:, 0], 40))), part)
    return lang, np.clip(part, 0, 1)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The input with the predicted language and its score, in columns named by ``out``."""
    sent = common.broadcast_value(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = sent.value
        for b in common.lean(batches):
            names, scores = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            o, flat = letter_words(common.strings(b[text_col]))
            codes, distinct = common.coded(flat)
            if langs and len(codes):
                buckets, at = trigrams(distinct)
                score = np.add.reduceat(table[buckets], at[:-1], axis=0)
                sizes = np.diff(o)
                full = np.flatnonzero(sizes)
                part = np.cumsum(sizes[full]) // CHUNK
                for k in np.unique(part):
                    rows = full[part == k]
                    lang, sure = infer(codes[o[rows[0]] : o[rows[-1] + 1]], sizes[rows], score)
                    names[rows], scores[rows] = np.asarray(langs, object)[lang], sure
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), pa.array(names, pa.string()), pa.array(scores)], [*b.schema.names, *out])

    own = docs.drop(*out)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(run, f"{kinds}, `{out[0]}` string, `{out[1]}` double")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows outside the held-out fold; doc_id, text, held_out, lang_pred, score of every row."""
    rows = docs.select("doc_id", "text", "lang", (common.fold("doc_id", 4) == 2).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")))
    return predict(rows.drop("lang"), model)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.documents(spark, sf_dir)).drop("text")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents go whose language is ``und`` or covers less than half of their words."""
    common.small_batches(spark)
    model = fit(docs.where(common.fold("doc_id", 4) != 2))
    lang, score = common.fresh(docs, "lang_pred"), common.fresh(docs, "score")
    judged = predict(docs, model, out=(lang, score))
    return judged.where((F.col(lang) != "und") & (F.col(score) >= 0.5)).select(*docs.columns)
