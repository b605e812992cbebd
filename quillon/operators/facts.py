"""Plain facts of pairs: token Jaccards, equal names, numbers, equal texts.

The search that finds a pair has both records at hand and tells its facts there, so that records don't travel once for each of
their pairs; it finds the pairs of the exact channels as well. Pairs of other channels meet their records in joins, and the same
function tells theirs. Ids are unique.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import blocking, features, retrieval

#: Sets of at most so many tokens are compared in columns, others pair by pair; pairs that are compared at once.
WIDTH, PAIRS = 24, 1 << 16
FLAGS = ("name_known", "name_equal", "address_missing", "non_latin", "numbers_known", "numbers_disjoint", "first_equal", "same_text")


def records(df: DataFrame) -> DataFrame:
    """Adds what pairs are compared by; records with all views and digest. Words and names are told by 64 bits of hash."""
    hashed = lambda v: F.transform(v, lambda t: F.xxhash64(t))
    name = F.col("name_content_compact")
    return df.withColumns({
        "name_words": hashed(F.array_distinct(tx.tokens(F.col("name_basic")))), "address_words": hashed(F.array_distinct(tx.tokens(F.col("address_basic")))), "numbers": hashed(tx.tokens(F.col("address_numbers"))),
        "name_hash": F.when(name != "", F.xxhash64(name)), "no_address": F.col("address_missing"), "other_script": F.col("name_script") != "Latin",
    })


def _sets(a: pa.ChunkedArray, b: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, sizes and tokens of two list columns; a token has the same number in both."""
    flat = [pa.concat_arrays(x.chunks).flatten().to_numpy(zero_copy_only=False) if x.num_chunks else np.zeros(0, np.int64) for x in (a, b)]
    codes = np.unique(np.concatenate(flat).astype(np.int64), return_inverse=True)[1].astype(np.int32)
    out, at = [], 0
    for x, own in zip((a, b), flat):
        n = pc.list_value_length(x).fill_null(0).to_numpy().astype(np.int64)
        out.append((np.cumsum(n) - n, n, codes[at : at + len(own)]))
        at += len(own)
    return out


def _columns(starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray, none: int) -> np.ndarray:
    """Token x of each row, at [x]; ``none`` where it has no such token, or too many."""
    held = np.where(sizes <= WIDTH, sizes, 0)
    out = np.full((int(held.max(initial=0)), len(sizes)), none, np.int32)
    for x in range(len(out)):
        rows = np.flatnonzero(held > x)
        out[x, rows] = codes[starts[rows] + x]
    return out


def shared(a: pa.ChunkedArray, b: pa.ChunkedArray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of rows (i of a, j of b), the sizes of both lists, and in how many places they have equal tokens (of sets: how many they share)."""
    (s, n, x), (t, m, y) = _sets(a, b)
    both, one, two = np.zeros(len(i), np.int64), _columns(s, n, x, -1), _columns(t, m, y, -2)
    for k in range(0, len(i), PAIRS):
        p, q = i[k : k + PAIRS], j[k : k + PAIRS]
        right = [c[q] for c in two]
        count = np.zeros(len(p), np.uint16)
        for left in one:
            left = left[p]
            for c in right:
                count += left == c
        both[k : k + PAIRS] = count
    for k in np.flatnonzero((n[i] > WIDTH) | (m[j] > WIDTH)):
        p, q = i[k], j[k]
        both[k] = len(np.intersect1d(x[s[p] : s[p] + n[p]], y[t[q] : t[q] + m[q]]))
    return n[i], m[j], both


def _jaccard(a: pa.ChunkedArray, b: pa.ChunkedArray, i: np.ndarray, j: np.ndarray) -> pa.Array:
    n, m, both = shared(a, b, i, j)
    return pa.array(both / np.maximum(n + m - both, 1), pa.float64(), mask=(n == 0) | (m == 0))


def _bool(x: pa.ChunkedArray) -> np.ndarray:
    return x.fill_null(False).to_numpy().astype(bool)


def _first(x: pa.ChunkedArray) -> np.ndarray:
    n = pc.list_value_length(x).fill_null(0).to_numpy().astype(np.int64)
    flat = pa.concat_arrays(x.chunks).flatten().to_numpy(zero_copy_only=False) if x.num_chunks else np.zeros(0, np.int64)
    return np.append(flat, 0)[np.where(n > 0, np.cumsum(n) - n, len(flat))]


def _digests(x: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(v if v is not None else bytes(16) for v in x.to_pylist()), np.uint64).reshape(-1, 2)


def told(a: pa.Table, b: pa.Table, i: np.ndarray, j: np.ndarray) -> list[pa.Array]:
    """country_key, name, address (Jaccards, null where a side has no words) and flags of pairs (row i of a, row j of b)."""
    x, y = a["name_hash"], b["name_hash"]
    named = ~x.is_null().to_numpy().astype(bool)[i] & ~y.is_null().to_numpy().astype(bool)[j]
    n, m, both = shared(a["numbers"], b["numbers"], i, j)
    numbers, d, e = (n > 0) & (m > 0), _digests(a["digest"]), _digests(b["digest"])
    same = (d[i] == e[j]).all(1) & a["digest"].is_valid().to_numpy().astype(bool)[i] & b["digest"].is_valid().to_numpy().astype(bool)[j]
    ak, bk = a["country_key"].combine_chunks().take(pa.array(i)), b["country_key"].combine_chunks().take(pa.array(j))
    same &= pc.equal(ak, bk).fill_null(False).to_numpy(zero_copy_only=False)
    flags = (
        named, named & (x.fill_null(0).to_numpy()[i] == y.fill_null(0).to_numpy()[j]), _bool(b["no_address"])[j], _bool(b["other_script"])[j],
        numbers, numbers & (both == 0), numbers & (_first(a["numbers"])[i] == _first(b["numbers"])[j]), same,
    )
    bits = sum(f.astype(np.int32) << k for k, f in enumerate(flags))
    return [ak, _jaccard(a["name_words"], b["name_words"], i, j), _jaccard(a["address_words"], b["address_words"], i, j), pa.array(bits, pa.int32())]


FACTS = retrieval.Carried(
    ("name_words", "address_words", "numbers", "name_hash", "no_address", "other_script", "digest"),
    {"country_key": ("string", pa.string()), "name": ("double", pa.float64()), "address": ("double", pa.float64()), "flags": ("int", pa.int32())}, told,
)
KEY, *VALUES = FACTS.gives


def flag(name: str) -> Column:
    return F.col("flags").bitwiseAND(1 << FLAGS.index(name)) != 0


def joined(pairs: DataFrame, s1: DataFrame, reference: DataFrame) -> DataFrame:
    """The pairs' columns and their facts, told after joins with the records."""
    side = lambda d: d.select("entity_id", "country_key", *FACTS.columns)
    rows, names = features.paired(pairs, side(s1), side(reference)), pairs.columns
    of = lambda t, p: pa.table({c: t[f"{p}_{c}"] for c in ("country_key", *FACTS.columns)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t, each = pa.Table.from_batches([b]), np.arange(b.num_rows)
                yield pa.RecordBatch.from_arrays([*(b[c] for c in names), *told(of(t, "s"), of(t, "c"), each, each)], [*names, *FACTS.gives])

    kinds = [*(f"{c} {kind}" for c, kind in pairs.dtypes), *(f"{c} {kind}" for c, (kind, _) in FACTS.gives.items())]
    return rows.mapInArrow(run, ", ".join(kinds))


def candidates(s1: DataFrame, reference: DataFrame, channels: Sequence[blocking.Channel] = blocking.FINAL_CHANNELS) -> DataFrame:
    """q, r, country_key, mask, name, address, flags: the pairs of blocking.generate() with their facts; they lie by q."""
    s1, reference = records(s1), records(reference)
    bit = {c.name: 1 << i for i, c in enumerate(channels)}
    search = next((c for c in channels if c.kind == "tokens"), None)  # finds the exact channels' pairs too
    equal = {f"key_{c.name}": c for c in channels if search and c.kind == "exact"}
    found = replace(FACTS, keys={k: bit[c.name] for k, c in equal.items()}), blocking.keyed(s1, reference, equal)
    parts = [c.run(s1, reference, *((replace(found[0], own=bit[c.name]), found[1]) if c is search else (replace(FACTS, own=bit[c.name]),))) for c in channels if c.kind in ("tokens", "chars")]
    parts = [d.select("q", "r", "bit", *FACTS.gives) for d in parts]
    plain = [c.run(s1, reference).select("q", "r", F.lit(bit[c.name]).alias("bit")) for c in channels if c.kind == "number" or (c.kind == "exact" and not search)]
    if plain:
        once = reduce(DataFrame.unionByName, plain).repartition("r").groupBy("q", "r").agg(F.bit_or("bit").alias("bit"))
        parts.append(joined(once, s1, reference))
    rows = reduce(DataFrame.unionByName, parts).repartition("q")
    return rows.groupBy("q", "r", KEY).agg(F.bit_or("bit").alias("mask"), *(F.max(c).alias(c) for c in VALUES))
