"""Similarities of pairs of strings, from 0 to 1; null where either side is ''.

Those that Spark can express stay in the JVM; edit similarities are pandas UDFs over Arrow batches, on bit-parallel
longest common subsequences.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillon.functions import text as tx


def _places(a: str) -> dict[str, int]:
    """For each character the set of its places, as bits."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    return at


def _lcs(at: dict[str, int], n: int, b: str) -> int:
    full = (1 << n) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = (s + u | s - u) & full
    return n - s.bit_count()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; one big-integer step for each character of b."""
    return _lcs(_places(a), len(a), b) if a and b else 0


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 2 * lcs(a, b) / n if n else 1.0


def _best_window(a: str, b: str) -> float:
    """Best ratio of a with windows of b of a's length, cut ones at both ends included.

    The characters that a window shares with a, in any order, bound its ratio; windows are tried by that bound until none
    can be better than the best found.
    """
    n, at = len(a), _places(a)
    need = {c: x.bit_count() for c, x in at.items()}
    shared, bounds = 0, []
    for i in range(1 - n, len(b)):
        if i + n <= len(b) and (c := b[i + n - 1]) in need:
            shared += need[c] > 0
            need[c] -= 1
        if i > 0 and (c := b[i - 1]) in need:
            need[c] += 1
            shared -= need[c] > 0
        if shared:
            bounds.append((2 * shared / (n + min(i + n, len(b)) - max(i, 0)), i))
    best = 0.0
    for bound, i in sorted(bounds, reverse=True):
        if bound <= best:
            break
        window = b[max(i, 0) : i + n]
        best = max(best, 2 * _lcs(at, n, window) / (n + len(window)))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with windows of the longer; of texts of one length, either's with the other's."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    best = _best_window(a, b)
    return max(best, _best_window(b, a)) if len(a) == len(b) and best < 1 else best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _sets(a: str, b: str) -> tuple[list[str], list[str], list[str]]:
    x, y = set(a.split()), set(b.split())
    return sorted(x & y), sorted(x - y), sorted(y - x)


def token_set_ratio(a: str, b: str) -> float:
    both, x, y = _sets(a, b)
    if both and (not x or not y):
        return 1.0
    one, two, common = " ".join(both + x), " ".join(both + y), " ".join(both)
    best = ratio(one, two)
    return max(best, ratio(common, one), ratio(common, two)) if both else best


def partial_token_ratio(a: str, b: str) -> float:
    both, x, y = _sets(a, b)
    if both:
        return 1.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(" ".join(x), " ".join(y)))


def jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(i - reach, 0), min(i + reach + 1, len(b))):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, (c for c, u in zip(b, used) if u))) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def weighted_ratio(a: str, b: str) -> float:
    """Best of the plain, token and partial ratios, weighted by how far the lengths differ."""
    if not a or not b:
        return 0.0
    far = max(len(a), len(b)) / min(len(a), len(b))
    token = max(token_sort_ratio(a, b), token_set_ratio(a, b))
    if far < 1.5:
        return max(ratio(a, b), 0.95 * token)
    scale = 0.9 if far <= 8 else 0.6
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


SCORERS = {
    "ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio,
    "jaro_winkler": jaro_winkler, "weighted_ratio": weighted_ratio,
}


def _udf(name: str):
    @F.pandas_udf(DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        scorer, seen = SCORERS[name], {}
        out = []
        for pair in zip(a, b):
            if not pair[0] or not pair[1]:
                out.append(None)
                continue
            if pair not in seen:
                seen[pair] = scorer(*pair)
            out.append(seen[pair])
        return pd.Series(out, dtype="float64").astype(object).where(pd.notna(pd.Series(out, dtype="float64")), None)

    return score


_UDFS = {name: _udf(name) for name in SCORERS}


def similarity(name: str, a: Column, b: Column) -> Column:
    """One of SCORERS for two columns."""
    return _UDFS[name](tx.as_text(a), tx.as_text(b))


def register(spark) -> None:
    """Makes the scorers callable from SQL as sim_<name>."""
    for name, udf in _UDFS.items():
        spark.udf.register(f"sim_{name}", udf)


def present(a: Column, b: Column) -> Column:
    return (tx.as_text(a) != "") & (tx.as_text(b) != "")


def exact(a: Column, b: Column) -> Column:
    return F.when(present(a, b), (a == b).cast("double"))


def prefix_match(a: Column, b: Column, n: int = 4) -> Column:
    return F.when(present(a, b), (F.left(a, F.lit(n)) == F.left(b, F.lit(n))).cast("double"))


def suffix_match(a: Column, b: Column, n: int = 4) -> Column:
    return F.when(present(a, b), (F.right(a, F.lit(n)) == F.right(b, F.lit(n))).cast("double"))


def length_difference(a: Column, b: Column) -> Column:
    return F.when(present(a, b), F.abs(F.length(a) - F.length(b)).cast("double"))


def length_ratio(a: Column, b: Column) -> Column:
    return F.when(present(a, b), F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)))


def char_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    x, y = tx.char_ngrams(a, n), tx.char_ngrams(b, n)
    return F.when(present(a, b), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def common_prefix_share(a: Column, b: Column) -> Column:
    """Leading characters that both share, over the shorter length."""
    short = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (a.substr(i, F.lit(1)) == b.substr(i, F.lit(1))), i).otherwise(n))
    return F.when(present(a, b), same / short)


def token_overlap(a: Column, b: Column, prefix: str) -> dict[str, Column]:
    """Six figures of two texts' distinct tokens."""
    x, y = F.array_distinct(tx.tokens(a)), F.array_distinct(tx.tokens(b))
    both, n, m = F.size(F.array_intersect(x, y)), F.size(x), F.size(y)
    full = (n > 0) & (m > 0)
    return {
        f"{prefix}_jaccard": F.when(full, both / (n + m - both)), f"{prefix}_containment_s1": F.when(full, both / n), f"{prefix}_containment_cand": F.when(full, both / m),
        f"{prefix}_overlap_count": both, f"{prefix}_count_s1": n, f"{prefix}_count_cand": m,
    }
