"""String similarities: native where Spark has them, one Arrow kernel, vectorised over a batch, for Jaro-Winkler and the Indel ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 unless both have text."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((a != "") & (b != ""), 1 - F.levenshtein(a, b) / longer).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column, common: Column | None = None) -> Column:
    """Of two arrays of distinct values (and how many are in both, if known); 0 if either is empty."""
    common = F.size(F.array_intersect(a, b)) if common is None else common
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column, common: Column | None = None) -> Column:
    common = F.size(F.array_intersect(a, b)) if common is None else common
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    free = every
    for c in b:
        hit = free & where.get(c, 0)
        free = (free + hit | free - hit) & every
    return len(a) - free.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2 * lcs_length(a, b) / total if total else 1.0


def token_set_ratio(a: str, b: str) -> float:
    """The best Indel ratio among the common words and what each side adds to them; 1 if one side adds nothing."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, only_x, only_y = x & y, x - y, y - x
    if common and (not only_x or not only_y):
        return 1.0
    left, right, shared = " ".join(sorted(only_x)), " ".join(sorted(only_y)), len(" ".join(sorted(common)))
    gap = 1 if shared else 0
    whole_left, whole_right = shared + gap + len(left), shared + gap + len(right)
    apart = len(left) + len(right) - 2 * lcs_length(left, right)
    best = 1 - apart / (whole_left + whole_right)
    if shared:
        best = max(best, 2 * shared / (shared + whole_left), 2 * shared / (shared + whole_right))
    return best


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro similarity, raised by the common prefix of up to 4 characters if above 0.7."""
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [c for c, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(first, second, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro)


#: Texts up to this length are compared many at once, a bit of a word for each character; rows of one turn.
LANES, TURN = 64, 8192
PAD = np.uint32(0xFFFFFFFF)


def _lanes(x: Sequence[str], y: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as rows of numbers; what is beyond a text never equals anything of the other side."""
    a, b = (np.array(side, f"U{LANES}").view(np.uint32).reshape(-1, LANES).copy() for side in (x, y))
    b[b == 0] = PAD
    return a, b


def _equal_bits(row: np.ndarray, character: np.ndarray) -> np.ndarray:
    """A word for each row: bit j says that its j-th character is that row's ``character``."""
    return np.packbits(row == character[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _below(n: np.ndarray) -> np.ndarray:
    """Words with the lowest n bits set, n from 0 to 64."""
    n = np.clip(n, 0, LANES).astype(np.uint64)
    return np.where(n == LANES, ~np.uint64(0), (np.uint64(1) << np.minimum(n, np.uint64(LANES - 1))) - np.uint64(1))


def _in_turns(x: Sequence[str], y: Sequence[str], lanes: Callable[[list[str], list[str]], np.ndarray], one: Callable[[str, str], float]) -> np.ndarray:
    """Pairs of short texts by ``lanes``, so many at once, the others by ``one``."""
    out = np.zeros(len(x))
    short = [i for i, (p, q) in enumerate(zip(x, y, strict=True)) if len(p) <= LANES and len(q) <= LANES]
    for i in range(0, len(short), TURN):
        part = short[i : i + TURN]
        out[part] = lanes([x[k] for k in part], [y[k] for k in part])
    for i in set(range(len(x))) - set(short):
        out[i] = one(x[i], y[i])
    return out


def lcs_lengths(x: Sequence[str], y: Sequence[str]) -> np.ndarray:
    """lcs_length of many pairs."""

    def lanes(p: list[str], q: list[str]) -> np.ndarray:
        a, b = _lanes(p, q)
        size = np.array([len(t) for t in p])
        every = _below(size)
        free = every.copy()
        for j in range(max(map(len, q), default=0)):
            hit = free & _equal_bits(a, b[:, j])
            free = ((free + hit) | (free - hit)) & every
        return size - np.bitwise_count(free)

    return _in_turns(x, y, lanes, lcs_length)


def jaro_winklers(x: Sequence[str], y: Sequence[str], weight: float = 0.1) -> np.ndarray:
    """jaro_winkler of many pairs."""

    def lanes(p: list[str], q: list[str]) -> np.ndarray:
        a, b = _lanes(p, q)
        la, lb = (np.array([len(t) for t in side]) for side in (p, q))
        reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
        taken, from_a = np.zeros(len(p), np.uint64), np.zeros((len(p), LANES), bool)
        for i in range(int(la.max(initial=0))):
            near = _below(np.minimum(lb, i + reach + 1)) & ~_below(i - reach)
            free = _equal_bits(b, a[:, i]) & near & ~taken
            free[la <= i] = 0
            taken |= free & (~free + np.uint64(1))  # the lowest bit
            from_a[:, i] = free != 0
        from_b = np.unpackbits(taken.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        m = from_a.sum(1)
        first, second = (np.take_along_axis(c, np.argsort(~f, axis=1, kind="stable"), 1) for c, f in ((a, from_a), (b, from_b)))
        swapped = ((first != second) & (np.arange(LANES) < m[:, None])).sum(1) // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(m > 0, (m / la + m / lb + (m - swapped) / m) / 3, 0.0)
        prefix = np.logical_and.accumulate(a[:, :4] == b[:, :4], axis=1).sum(1)
        return np.where(jaro > 0.7, jaro + prefix * weight * (1 - jaro), jaro)

    return _in_turns(x, y, lanes, lambda p, q: jaro_winkler(p, q, weight))


def indel_ratios(x: Sequence[str], y: Sequence[str]) -> np.ndarray:
    total = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)])
    return np.where(total > 0, 2 * lcs_lengths(x, y) / np.maximum(total, 1), 1.0)


def token_set_ratios(x: Sequence[str], y: Sequence[str]) -> np.ndarray:
    """token_set_ratio of many pairs: words are split one pair after another, what differs is compared at once."""
    out, left, right, rest = np.zeros(len(x)), [], [], []
    for i, (p, q) in enumerate(zip(x, y, strict=True)):
        u, v = set(p.split()), set(q.split())
        if u and v:
            common, only_u, only_v = u & v, u - v, v - u
            if common and (not only_u or not only_v):
                out[i] = 1.0
            else:
                left.append(" ".join(sorted(only_u)))
                right.append(" ".join(sorted(only_v)))
                rest.append((i, len(" ".join(sorted(common)))))
    if rest:
        where, shared = (np.array(c) for c in zip(*rest, strict=True))
        ll, lr = (np.array([len(t) for t in side]) for side in (left, right))
        whole_left, whole_right = shared + (shared > 0) + ll, shared + (shared > 0) + lr
        best = 1 - (ll + lr - 2 * lcs_lengths(left, right)) / (whole_left + whole_right)
        most = np.maximum(2 * shared / (shared + whole_left), 2 * shared / (shared + whole_right))
        out[where] = np.where(shared > 0, np.maximum(best, most), best)
    return out


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("jw", "token_sort", "token_set")]))
def fuzzy(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """(a, b, a with sorted words, b with sorted words): each distinct pair of an Arrow batch once, all of them at once."""
    for a, b, sorted_a, sorted_b in parts:
        rows = pd.DataFrame({"a": a, "b": b, "sa": sorted_a, "sb": sorted_b})
        some = rows[(rows.a.fillna("") != "") & (rows.b.fillna("") != "")].drop_duplicates()
        x, y, sx, sy = (some[c].tolist() for c in ("a", "b", "sa", "sb"))
        some = some.assign(jw=jaro_winklers(x, y), token_sort=indel_ratios(sx, sy), token_set=token_set_ratios(x, y))
        yield rows.merge(some, "left", ["a", "b", "sa", "sb"])[["jw", "token_sort", "token_set"]].fillna(0.0)
