"""Jaro-Winkler similarity: an Arrow function behind a lossless native filter, and all similar pairs of two lists by bits."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


@lru_cache(maxsize=100_000)
def jaro_winkler(a: str, b: str) -> float:
    """Similarity of two texts from 0 to 1; 0 if either is empty. The boost counts up to four equal first characters, above 0.7."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    reach = max(reach, 0)
    used = bytearray(len(b))
    mine = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = 1
                mine.append(ch)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [ch for ch, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(mine, theirs)) // 2
    score = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if score <= 0.7:
        return score
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return score + prefix * 0.1 * (1 - score)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`jaro_winkler` of two columns."""
    return pd.Series([jaro_winkler(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """Lossless test on lengths and first characters: false only where Jaro-Winkler stays below ``threshold``.

    With p equal first characters (at most 4) the Jaro part must reach j = (t - p/10) / (1 - p/10); Jaro is at most
    (2 + shorter/longer) / 3.
    """
    p = F.lit(0)
    same = F.lit(True)
    for k in range(1, 5):
        same = same & (F.substring(a, k, 1) == F.substring(b, k, 1)) & (F.length(a) >= k) & (F.length(b) >= k)
        p = p + F.when(same, 1).otherwise(0)
    need = 3 * ((threshold - p * 0.1) / (1 - p * 0.1)) - 2
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return (F.length(a) > 0) & (F.length(b) > 0) & (ratio >= need - 1e-9)


LONGEST = 256  # characters; longer texts are compared one by one
_ONES = np.array([(1 << n) - 1 for n in range(65)], np.uint64)


class _Texts:
    """Texts as codes by place, as bits of the places of each character, and as a signature of character counts."""

    def __init__(self, texts: list[str]):
        self.texts, n = texts, len(texts)
        self.length = np.array([len(t) for t in texts], np.int64)
        cut = [t[:LONGEST] for t in texts]
        size = np.minimum(self.length, LONGEST)
        flat = np.frombuffer("".join(cut).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, codes = np.unique(flat, return_inverse=True)
        row = np.repeat(np.arange(n), size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        self.codes = np.zeros((max(4, int(size.max(initial=0))), n), np.int32)  # by place, 0 where the text is over
        self.codes[place, row] = codes + 1
        self.words = max(1, -(-int(size.max(initial=0)) // 64))
        self.places = np.zeros((self.words, (len(chars) + 1) * n), np.uint64)
        np.bitwise_or.at(self.places, (place // 64, (codes + 1) * n + row), np.uint64(1) << (place % 64).astype(np.uint64))
        i, reach = np.arange(len(self.codes))[:, None], np.arange(max(1, len(self.codes) // 2))[None, :]
        self.spans = [_ONES[np.clip(i + reach + 1 - 64 * w, 0, 64)] & ~_ONES[np.clip(i - reach - 64 * w, 0, 64)] for w in range(self.words)]  # places within a reach of a place
        self.rows = self.codes.astype(np.int64) * n
        # A bit says that a character occurs at least k times; those that divide the texts best are kept, at most 256.
        counts = np.zeros((len(chars), n), np.int16)
        np.add.at(counts, (codes, row), 1)
        bits = [(c, k) for c, most in enumerate(counts.max(axis=1, initial=0)) for k in range(1, min(int(most), 8) + 1)]
        share = np.array([np.mean(counts[c] >= k) for c, k in bits])
        bits = [bits[x] for x in np.argsort(-share * (1 - share), kind="stable")[:256]]
        self.signature = np.zeros((4, n), np.uint64)
        for x, (c, k) in enumerate(bits):
            self.signature[x // 64] |= (counts[c] >= k).astype(np.uint64) << np.uint64(x % 64)
        self.unsigned = (self.length - np.bitwise_count(self.signature).sum(axis=0, dtype=np.int64)).astype(np.float32)
        self.first = np.zeros((4, n), np.int64)  # number of the first one to four characters, none where the text is shorter
        for k in range(4):
            self.first[k] = np.unique(self.codes[: k + 1], axis=1, return_inverse=True)[1].reshape(-1)
            self.first[k][self.length <= k] = -1 - np.arange(n)[self.length <= k]


def _matches(t: _Texts, a: np.ndarray, b: np.ndarray, least: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Numbers of the pairs with at least ``least`` matching characters, how many they have, and their places in both texts; others are left as early as possible."""
    live = np.argsort(-t.length[a], kind="stable")
    a, b, least = a[live], b[live], least[live]
    la = t.length[a]
    reach = np.maximum(np.maximum(la, t.length[b]) // 2 - 1, 0)
    free = [np.full(len(a), _ONES[64]) for _ in range(words)]
    mine = [np.zeros(len(a), np.uint64) for _ in range(words)]
    m = np.zeros(len(a), np.int16)
    for i in range(int(la.max(initial=0))):
        k = int(np.searchsorted(-la, -i))  # the texts that have a place i
        at = t.rows[i][a[:k]] + b[:k]
        got = None
        for w in range(words):
            x = t.places[w][at]
            x &= t.spans[w][i][reach[:k]]
            x &= free[w][:k]
            x &= np.negative(x)
            if got is not None:
                x[got] = 0
            free[w][:k] ^= x
            got = x != 0 if got is None else got | (x != 0)
        m[:k] += got
        mine[i // 64][:k] |= got.astype(np.uint64) << np.uint64(i % 64)
        if i % 8 == 7:
            keep = m + np.maximum(la - i - 1, 0) >= least
            if keep.sum() < 0.8 * len(keep):
                live, a, b, least, la, reach, m, free, mine = live[keep], a[keep], b[keep], least[keep], la[keep], reach[keep], m[keep], [x[keep] for x in free], [x[keep] for x in mine]
    keep = m >= least
    return live[keep], m[keep].astype(np.int64), [x[keep] for x in mine], [~x[keep] for x in free]


def _swaps(t: _Texts, a: np.ndarray, b: np.ndarray, m: np.ndarray, most: np.ndarray, mine: list[np.ndarray], theirs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs with at most ``most`` swaps, matching characters that stand in another order, halved; and how many they have."""
    live = np.argsort(-m, kind="stable")
    a, b, m, most, mine, theirs = a[live], b[live], m[live], 2 * most[live] + 1, [x[live] for x in mine], [x[live] for x in theirs]
    other = np.zeros(len(a), np.int64)
    for step in range(int(m.max(initial=0))):
        k = int(np.searchsorted(-m, -step))  # the pairs that have so many matching characters
        place, same, left_of, right_of = np.zeros(k, np.int64), np.zeros(k, bool), np.ones(k, bool), np.ones(k, bool)
        for w, x in enumerate(mine):
            low = x[:k] & np.negative(x[:k])
            if w:
                low[~left_of] = 0
            x[:k] ^= low
            took = low != 0
            place += np.where(took, 64 * w + np.bitwise_count(low - np.uint64(1)).astype(np.int64), 0)
            left_of &= ~took
        at = t.rows[place, a[:k]] + b[:k]
        for w, x in enumerate(theirs):
            low = x[:k] & np.negative(x[:k])
            if w:
                low[~right_of] = 0
            x[:k] ^= low
            same |= (t.places[w][at] & low) != 0
            right_of &= low == 0
        other[:k] += ~same
        if step % 6 == 5:
            keep = other <= most
            if keep.sum() < 0.8 * len(keep):
                live, a, b, m, most, other, mine, theirs = live[keep], a[keep], b[keep], m[keep], most[keep], other[keep], [x[keep] for x in mine], [x[keep] for x in theirs]
    keep = other <= most
    return live[keep], other[keep] // 2


def similar_pairs(texts: list[str], left: np.ndarray, right: np.ndarray | None, order: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``first, second, score``: all pairs of a ``left`` and a ``right`` place of ``texts``, or of two ``left`` places, whose Jaro-Winkler is at least ``threshold``.

    The one of smaller ``order`` is first; pairs of equal order are left out. Scores equal :func:`jaro_winkler` to the last bit.
    Signatures bound the matching characters from above, so no pair is lost before the matching itself, which is done for
    many pairs at once with one bit for each place.
    """
    t = _Texts(texts)
    # With p equal first characters Jaro must reach this share; Winkler's boost needs more than 0.7.
    need = np.array([3 * min(threshold, max(0.7, (threshold - p * 0.1) / (1 - p * 0.1))) - 1 for p in range(5)])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settle() -> None:
        a, b, p = (np.concatenate(x) for x in zip(*held))
        held.clear()
        turned = order[a] > order[b]
        a, b = np.where(turned, b, a), np.where(turned, a, b)
        la, lb = t.length[a], t.length[b]
        least = np.ceil(np.maximum(need[p], 0) * (la * lb / (la + lb)) - 1e-3).astype(np.int64)
        long = (la > LONGEST) | (lb > LONGEST)
        if long.any():
            found.append((a[long], b[long], np.array([jaro_winkler(texts[x], texts[y]) for x, y in zip(a[long], b[long])])))
        for words in range(1, t.words + 1):
            own = np.flatnonzero(~long & (np.maximum(1, -(-np.maximum(la, lb) // 64)) == words))
            if not len(own):
                continue
            live, m, mine, theirs = _matches(t, a[own], b[own], np.maximum(least[own], 1), words)
            own = own[live]
            most = np.floor(m * (m / la[own] + m / lb[own] - need[p[own]]) + 1e-6).astype(np.int64)
            live, swaps = _swaps(t, a[own], b[own], m, most, mine, theirs)
            own, m = own[live], m[live]
            score = (m / la[own] + m / lb[own] + (m - swaps) / m) / 3
            score = np.where(score > 0.7, score + p[own] * 0.1 * (1 - score), score)
            found.append((a[own], b[own], score))

    others = left if right is None else right
    their_length, their_unsigned = t.length[others].astype(np.float32), t.unsigned[others]
    step, waiting = max(1, 200_000 // max(1, len(others))), 0
    for start in range(0, len(left), step):
        mine = left[start : start + step]
        shared = np.zeros((len(mine), len(others)), np.uint8)
        for w in t.signature:
            if w.any():
                shared += np.bitwise_count(w[mine][:, None] & w[others][None, :])
        p = np.zeros(shared.shape, np.uint8)
        for k in t.first:
            p += k[mine][:, None] == k[others][None, :]
        own = t.length[mine].astype(np.float32)[:, None]
        most = shared + np.minimum(t.unsigned[mine][:, None], their_unsigned[None, :])
        able = most + np.float32(1e-2) >= need.astype(np.float32)[p] * (own * their_length[None, :] / (own + their_length[None, :]))
        if right is None:
            able &= np.arange(start, start + len(mine))[:, None] < np.arange(len(others))[None, :]
        i, j = np.nonzero(able)
        a, b = mine[i], others[j]
        if len(a):
            held.append((a, b, p[i, j].astype(np.int64)))
            waiting += len(a)
        if waiting > 60_000:
            settle()
            waiting = 0
    if held:
        settle()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, score = (np.concatenate(x) for x in zip(*found))
    codes = np.unique(np.array(texts, object), return_inverse=True)[1]
    score = np.where(codes[a] == codes[b], 1.0, score)
    keep = (score >= threshold) & (order[a] != order[b])
    return a[keep], b[keep], score[keep]
