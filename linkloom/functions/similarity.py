"""Similarities of token sets (Column expressions) and of strings (one vectorised function)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import lanes


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over those of the smaller set; 0 if one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def bigrams(text: Column) -> Column:
    """Character bigrams with repeats as sorted numbers: both code points and the number of the occurrence, so that sets compare as multisets."""
    n = F.length(text) - 1
    none = F.array().cast("array<bigint>")
    code = lambda i: F.ascii(F.substr(text, i, F.lit(1))).cast("long")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.shiftleft(F.shiftleft(code(i), 21).bitwiseOR(code(i + 1)), 20))
    numbered = lambda g: F.transform(g, lambda x, i: x + (i - F.array_position(g, x) + 1))
    return F.when(n < 1, none).otherwise(F.get(F.transform(F.array(F.array_sort(pairs)), numbered), 0))


def bigram_overlap(a: Column, b: Column) -> Column:
    """Shared numbered bigrams over the root of both counts' product; 0 if one has none."""
    either = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(either, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b)))


# --- strings ---------------------------------------------------------------------------


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """2 * common subsequence / both lengths; 1 for two empty strings."""
    n = len(a) + len(b)
    return 2 * common_length(a, b) / n if n else 1.0


def _best_window(a: str, b: str) -> float:
    """Best ``ratio`` of ``a`` and a window of ``b`` of its length, or shorter at either end."""
    best, m, letters = 0.0, len(a), set(a)
    for i in range(1 - m, len(b)):
        lo, hi = max(0, i), min(len(b), i + m)
        if hi - lo == m and b[hi - 1] not in letters:
            continue  # the window one to the left is as good
        if 2 * (hi - lo) / (m + hi - lo) > best:
            best = max(best, ratio(a, b[lo:hi]))
            if best == 1.0:
                break
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ``ratio`` of the shorter string and a window of the longer; either way round for equal lengths."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    return max(_best_window(a, b), _best_window(b, a)) if len(a) == len(b) else _best_window(a, b)


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio of the shared tokens and the shared tokens with either rest; 0 if a side is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, one, two = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not one or not two):
        return 1.0
    gap = 1 if both else 0
    first, second = len(both) + gap + len(one), len(both) + gap + len(two)
    found = 2 * (len(both) + gap + common_length(one, two)) / (first + second)
    if not both:
        return found
    return max(found, 2 * len(both) / (len(both) + first), 2 * len(both) / (len(both) + second))


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro similarity raised by up to four equal first letters where it is over 0.7; 1 for two empty strings."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, pairs = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                pairs.append(c)
                break
    m = len(pairs)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(pairs, (b[j] for j in range(len(b)) if taken[j]))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


KERNELS = {"ratio": ratio, "partial": partial_ratio, "token_set": token_set_ratio, "token_sort": token_sort_ratio, "jw": jaro_winkler}
#: Scores of pairs that a Python worker remembers, at most.
REMEMBERED = 1 << 15


def _token_sets(words: list[list[str]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``token_set_ratio`` of the pairs of texts (by index), each text given as its sorted distinct words."""
    found, rest, sizes = np.zeros(len(x)), ([], [], []), []
    sets = [set(w) for w in words]
    whole = [sum(map(len, w)) + len(w) - 1 for w in words]
    for k, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        if not words[i] or not words[j]:
            continue
        own, other = sets[i], sets[j]
        one, two = " ".join([t for t in words[i] if t not in other]), " ".join([t for t in words[j] if t not in own])
        # What is left of the first text beside the words of its own, and the blank between them.
        both = max(0, whole[i] - len(one) - 1) if one else whole[i]
        if both and (not one or not two):
            found[k] = 1.0
            continue
        for column, value in zip(rest, (k, one, two)):
            column.append(value)
        sizes.append((both, len(one), len(two)))
    if sizes:
        both, one, two = np.array(sizes).T
        gap = both > 0
        first, second = both + gap + one, both + gap + two
        shared = lanes.in_batches(lanes.common_lengths, rest[1], rest[2])
        score = 2 * (both + gap + shared) / (first + second)
        found[rest[0]] = np.where(gap, np.maximum(score, np.maximum(2 * both / (both + first), 2 * both / (both + second))), score)
    return found


def all_scores(a: list[str], b: list[str], kinds: tuple[str, ...] = tuple(KERNELS)) -> dict[str, np.ndarray]:
    """The scores ``kinds`` of each pair, over all pairs at once. Very long texts go through the kernels one by one."""
    lone = [i for i, (x, y) in enumerate(zip(a, b)) if len(x) * len(y) > lanes.CELLS or "\0" in x or "\0" in y]
    apart = set(lone)
    at = np.array([i for i in range(len(a)) if i not in apart], np.int64)
    out = {k: np.zeros(len(a)) for k in kinds}
    for i in lone:
        for k in kinds:
            out[k][i] = KERNELS[k](a[i], b[i])
    if len(at) and {"ratio", "partial"} & out.keys():
        _ratios(a, b, at, out)
    if len(at) and {"token_set", "token_sort"} & out.keys():
        _token_scores(a, b, at, out)
    if len(at) and "jw" in out:
        fits = np.array([len(b[i]) <= lanes.WORD for i in at.tolist()])
        in_word = at[fits].tolist()
        out["jw"][in_word] = lanes.in_batches(lanes.jaro_winklers, [a[i] for i in in_word], [b[i] for i in in_word])
        for i in at[~fits].tolist():
            out["jw"][i] = jaro_winkler(a[i], b[i])
    return out


def _ratios(a: list[str], b: list[str], at: np.ndarray, out: dict[str, np.ndarray]) -> None:
    """``ratio`` and ``partial`` of the pairs ``at`` come of one braid."""
    short, long = zip(*((a[i], b[i]) if len(a[i]) <= len(b[i]) else (b[i], a[i]) for i in at.tolist()))
    whole, partial = lanes.in_batches(lanes.ratios, short, long, 2)
    # Texts of one length: windows of either.
    even = [i for i, (x, y) in enumerate(zip(short, long)) if len(x) == len(y) and x != y]
    if even:
        partial[even] = np.maximum(partial[even], lanes.in_batches(lanes.ratios, [long[i] for i in even], [short[i] for i in even], 2)[1])
    for kind, found in (("ratio", whole), ("partial", partial)):
        if kind in out:
            out[kind][at] = found


def _token_scores(a: list[str], b: list[str], at: np.ndarray, out: dict[str, np.ndarray]) -> None:
    """``token_sort`` and ``token_set`` of the pairs ``at``; each text is split once."""
    where, texts = pd.factorize(np.array([*(a[i] for i in at.tolist()), *(b[i] for i in at.tolist())], object))
    x, y = where[: len(at)], where[len(at) :]
    split = [t.split() for t in texts]
    if "token_sort" in out:
        ordered = [" ".join(sorted(w)) for w in split]
        one, two = [ordered[i] for i in x.tolist()], [ordered[i] for i in y.tolist()]
        total = np.array([len(p) + len(q) for p, q in zip(one, two)])
        out["token_sort"][at] = np.where(total > 0, 2 * lanes.in_batches(lanes.common_lengths, one, two) / np.maximum(total, 1), 1.0)
    if "token_set" in out:
        out["token_set"][at] = _token_sets([sorted(set(w)) for w in split], x, y)


#: By the kinds of scores: those of pairs that this process had before.
_known: dict[tuple[str, ...], dict[tuple[str, str], tuple[float, ...]]] = {}


def remembered(a: list[str], b: list[str], kinds: tuple[str, ...]) -> dict[str, np.ndarray]:
    """``all_scores``, but of pairs that were not met lately only."""
    known = _known.setdefault(kinds, {})
    asked = list(zip(a, b))
    rows = [known.get(p) for p in asked]
    new = [i for i, r in enumerate(rows) if r is None]
    if new:
        if len(known) + len(new) > REMEMBERED:
            known.clear()
        scores = all_scores([a[i] for i in new], [b[i] for i in new], kinds)
        for i, *row in zip(new, *(scores[k].tolist() for k in kinds)):
            rows[i] = row
            if len(known) < REMEMBERED:
                known[asked[i]] = row
    return dict(zip(kinds, np.array(rows, float).reshape(-1, len(kinds)).T))


def scores_of(a: pd.Series, b: pd.Series, kinds: tuple[str, ...], repeats: bool) -> pd.DataFrame:
    """The scores ``kinds`` of a batch; equal pairs are computed once. ``repeats``: the next batches are likely to have these pairs too."""
    (x, left), (y, right) = (pd.factorize(s.fillna("")) for s in (a, b))
    pairs, back = np.unique(x.astype(np.int64) * max(1, len(right)) + y, return_inverse=True)
    one, two = [left[i] for i in pairs // max(1, len(right))], [right[i] for i in pairs % max(1, len(right))]
    scores = (remembered if repeats else all_scores)(one, two, kinds)
    return pd.DataFrame({k: v[back] for k, v in scores.items()})


def string_scores(a: str, b: str, kinds: tuple[str, ...] = tuple(KERNELS), repeats: bool = False) -> Column:
    """A struct of the string scores ``kinds`` of two columns; no others are computed."""
    kind = T.StructType([T.StructField(k, T.DoubleType()) for k in kinds])

    @F.pandas_udf(kind)
    def scored(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return scores_of(x, y, kinds, repeats)

    return scored(a, b)
