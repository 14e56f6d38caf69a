"""The pairs of many records with the targets of their keys, scored and ranked from posting lists in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs and records that are handed on together, at about.
PAIRS, RECORDS = 1 << 18, 1024
#: Pairs that are unfolded together, at about: Spark holds their rows at once.
PAIR_ROWS = 1 << 16
#: Keys of more targets are scored once for all records in a row that share them; so many of them at most.
SHARED, MOST_SHARED = 200, 32


class Postings:
    """The targets of each key. Targets are numbered in the order of their ids."""

    def __init__(self, keys: list[np.ndarray], ids: list[pa.Array]):
        at = pa.chunked_array(ids, pa.string()).combine_chunks().dictionary_encode()
        order = pc.sort_indices(at.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.ids = at.dictionary.take(pa.array(order))
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        by_key = np.argsort(key, kind="stable")
        self.targets = rank[at.indices.to_numpy()][by_key]
        found, first = np.unique(key[by_key], return_index=True)
        self.of = dict(zip(found.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(key)])))
        self.score, self.count = np.zeros(len(order)), np.zeros(len(order), np.int64)
        # Of the frequent keys that are shared just now: which of them each target has, as bits.
        self.shared, self.has, self.taken = None, np.zeros(len(order), np.uint32), np.zeros(len(order), bool)
        self.place = np.zeros(len(order), np.int64)
        self.common = self.targets[:0], np.zeros(0), np.zeros(0, np.int64)
        self.best, self.first = self.common, 0

    def at(self, key: int) -> np.ndarray:
        first, last = self.of.get(key, (0, 0))
        return self.targets[first:last]

    def share(self, keys: np.ndarray, gain: np.ndarray, least: int) -> None:
        """Scores the targets of frequent keys, for the records that have just these of them."""
        self.has[self.common[0]] = 0
        met = []
        for i, k in enumerate(keys.tolist()):
            at = self.at(k)
            met.append(at[self.has[at] == 0])
            self.has[at] |= np.uint32(1 << i)
        at = np.concatenate(met) if met else self.targets[:0]
        self.shared, self.common = (keys.tobytes(), least), (at, *self.added(at, np.zeros(len(at)), np.zeros(len(at), np.int64), gain))
        self.best, self.first = None, 0

    def added(self, at: np.ndarray, score: np.ndarray, count: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and counts with those of the shared keys, added key by key as ``pairs`` does."""
        has = self.has[at]
        for i, g in enumerate(gain.tolist()):
            score = score + g * (has >> np.uint32(i) & np.uint32(1))
        return score, count + np.bitwise_count(has)

    def leading(self, n: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``n`` best targets or more of the shared keys alone, in order."""
        if self.best is None or len(self.best[0]) < n and self.first < len(self.common[0]):
            self.first = 2 * n
            self.best = in_order(*self.common, self.first, least)
        return self.best

    def top(self, keys: np.ndarray, df: np.ndarray, n_targets: int, m: int | None, cap: int | None, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``pairs`` gives, to the last bit. Records in a row that share their frequent keys share the work on them.

        Only targets of the record's rarer keys are scored for it alone; of the others, the
        best by the shared keys are the best for every record that shares them.
        """
        rare = int(np.searchsorted(df, SHARED, "right"))
        if m is None or len(keys) - rare > MOST_SHARED or len(keys) and cap is not None and df[-1] > cap:
            return self.pairs(keys, df, n_targets, m, cap, least)
        gain = np.log(1 + n_targets / (df + 1))
        if self.shared != (keys[rare:].tobytes(), least):
            self.share(keys[rare:], gain[rare:], least)
        lists = [self.at(k) for k in keys[:rare].tolist()]
        own, place = np.unique(np.concatenate([self.targets[:0], *lists]), return_inverse=True)
        sizes = [len(x) for x in lists]
        score, count = self.added(own, np.bincount(place, np.repeat(gain[:rare], sizes), len(own)), np.bincount(place, minlength=len(own)), gain[rare:])
        at, high, n = self.leading(m + len(own), least)
        self.taken[own] = True
        other = ~self.taken[at]
        self.taken[own] = False
        return in_order(np.concatenate([own, at[other]]), np.concatenate([score, high[other]]), np.concatenate([count, n[other]]), m, least)

    def all(self, keys: np.ndarray, df: np.ndarray, n_targets: int, least: int, counted: bool) -> tuple[np.ndarray, ...]:
        """All that ``pairs`` gives, or without counts, to the last bit. A key always scores, so that targets met before are known by their score."""
        if counted or least > 1:
            return self.pairs(keys, df, n_targets, None, None, least)[: 2 + counted]
        met = [self.targets[:0]]
        for k, g in zip(keys.tolist(), np.log(1 + n_targets / (df + 1)).tolist()):
            at = self.at(k)
            score = self.score[at]
            met.append(at[score == 0])
            self.score[at] = score + g
        at = np.concatenate(met)
        score = self.score[at]
        self.score[at] = 0
        return in_order(at, score, score, None, 1)[:2]

    def pairs(self, keys: np.ndarray, df: np.ndarray, n_targets: int, m: int | None, cap: int | None, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Targets, scores and shared keys of one record, whose keys come by frequency: all, or the ``m`` best in order.

        From the first key of more than ``cap`` targets on, targets that have none of the
        keys before are left out where ``m`` others score more already than all keys that
        are left could give.
        """
        gain, met, closed = np.log(1 + n_targets / (df + 1)), [], False
        for i, k in enumerate(keys.tolist()):
            first, last = self.of.get(k, (0, 0))
            at = self.targets[first:last]
            seen = self.count[at]
            if not closed and m is not None and cap is not None and df[i] > cap:
                so_far = np.concatenate(met) if met else at[:0]
                sure = self.score[so_far[self.count[so_far] >= least]]
                # Scores are rounded to six places.
                closed = len(sure) >= m and np.partition(sure, len(sure) - m)[len(sure) - m] > gain[i:].sum() + 2e-6
            if closed:
                at, seen = at[seen > 0], seen[seen > 0]
            else:
                met.append(at[seen == 0])
            self.count[at] = seen + 1
            self.score[at] += gain[i]
        at = np.concatenate(met) if met else self.targets[:0]
        score, count = self.score[at], self.count[at]
        self.score[at], self.count[at] = 0, 0
        return in_order(at, score, count, m, least)


def in_order(at: np.ndarray, score: np.ndarray, count: np.ndarray, m: int | None, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets with rounded scores that share ``least`` keys: all, or the ``m`` best by score, shared keys and id."""
    score = np.floor(score * 1e6 + 0.5) / 1e6
    if least > 1:
        at, score, count = (x[count >= least] for x in (at, score, count))
    if m is None:
        return at, score, count
    if len(at) > m:
        high = score >= np.partition(score, len(at) - m)[len(at) - m]
        at, score, count = at[high], score[high], count[high]
    best = np.lexsort((at, -count, -score))[:m]
    return at[best], score[best], count[best]


def probing(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple | None]:
    """Rows of ``part, key_id, t_id, s1_id, probes, carried``, a part's postings before its records, to ``part, postings, row, keys, df`` of each record; after a part's last one: None."""
    part, keys, ids, index = None, [], [], None
    for batch in rows:
        parts, posting = batch.column(0).to_numpy(), batch.column(3).is_null().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(parts) != 0) | np.diff(posting)) + 1 if len(parts) else []
        for first, last in zip([0, *cuts], [*cuts, len(parts)]):
            if first == last:
                continue
            if parts[first] != part:
                part, keys, ids, index = parts[first], [], [], None
                yield None
            some = batch.slice(first, last - first)
            if posting[first]:
                keys.append(some.column(1).to_numpy())
                ids.append(some.column(2))
                continue
            if index is None:
                index, keys, ids = Postings(keys, ids), [], []
            lists = some.column(4)
            key_id, df = lists.flatten().flatten()
            key_id, df, at = key_id.to_numpy(), df.to_numpy(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
            for i in range(some.num_rows):
                own = slice(at[i], at[i + 1])
                yield part, index, some.slice(i, 1), key_id[own], df[own]
    yield None


def ranked(rows: Iterator[pa.RecordBatch], n_targets: int, m: int | None, cap: int | None, least: int) -> Iterator[pa.RecordBatch]:
    """Rows that ``probing`` takes (records best with those in a row that share their frequent keys) to rows of ``part, s1_id, carried, t_ids, scores, counts``."""
    part, index, waiting, n = None, None, [], 0
    for met in probing(rows):
        if met is not None:
            part, index, row, keys, df = met
            waiting.append((row, *index.top(keys, df, n_targets, m, cap, least)))
            n += len(waiting[-1][1])
        if waiting and (met is None or n >= PAIRS or len(waiting) >= RECORDS):
            yield handed(part, index, waiting)
            waiting, n = [], 0
        if met is None:
            index = None


def paired(rows: Iterator[pa.RecordBatch], n_targets: int, least: int, counted: bool) -> Iterator[pa.RecordBatch]:
    """Rows that ``probing`` takes to rows of ``s1_ids, t_ids, places, scores`` and, if ``counted``, ``counts``: all pairs of some records at a time.

    Each id stands once in a row; a pair's place holds that of its record in the upper half, that of its target in the lower.
    """
    index, waiting, n = None, [], 0
    for met in probing(rows):
        if met is not None:
            _, index, row, keys, df = met
            name, found = row.column(3)[0].as_py(), index.all(keys, df, n_targets, least, counted)
            for first in range(0, len(found[0]), PAIR_ROWS):
                waiting.append((name, *(x[first : first + PAIR_ROWS] for x in found)))
                n += len(waiting[-1][1])
                if n >= PAIR_ROWS:
                    yield by_place(index, waiting)
                    waiting, n = [], 0
        else:
            if waiting:
                yield by_place(index, waiting)
            index, waiting, n = None, [], 0


def by_place(index: Postings, waiting: list) -> pa.RecordBatch:
    names, *found = zip(*waiting)
    at, *made = map(np.concatenate, found)
    index.taken[at] = True
    own = np.flatnonzero(index.taken)
    index.taken[own], index.place[own] = False, np.arange(len(own))
    places = np.repeat(np.arange(len(names)) << 32, [len(x) for x in found[0]]) | index.place[at]
    lists = [pa.array(names, pa.string()), index.ids.take(pa.array(own)), *map(pa.array, (places, *made))]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], ["s1_ids", "t_ids", "places", "scores", "counts"][: len(lists)])


def handed(part: int, index: Postings, waiting: list) -> pa.RecordBatch:
    own = pa.Table.from_batches([x[0] for x in waiting]).combine_chunks()
    ends = pa.array(np.concatenate([[0], np.cumsum([len(x[1]) for x in waiting])]), pa.int32())
    at, score, count = (np.concatenate([x[i] for x in waiting]) for i in (1, 2, 3))
    lists = [pa.ListArray.from_arrays(ends, x) for x in (index.ids.take(pa.array(at)), pa.array(score), pa.array(count))]
    s1_id, carried = (own.column(c).combine_chunks() for c in ("s1_id", "carried"))
    s1_id, carried = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (s1_id, carried))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(waiting), part), pa.int32()), s1_id, carried, *lists], ["part", "s1_id", "carried", "t_ids", "scores", "counts"])
