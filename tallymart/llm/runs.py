"""Runs of repeated words, by refining classes of equal factors length by length."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm.terms import Numbers, ranges, type_of
from tallymart.llm.words import prefer_small_batches, texts_as_bytes

#: A run has at least so many words, and at least so many periods.
LEAST, PERIODS = 24, 3
#: Words whose classes are refined together, of as many texts as that takes.
CHUNK = 1 << 20
#: Up to this length all places are looked at for squares; beyond it, only pairs of neighbours noted with their distance.
_LOOKED = 16


class _Classes:
    """Classes of places where equal factors of one length start, of many texts side by side.

    A class is a slice of ``order``, and its places are linked in ascending
    order. Every text ends in a place of its own that equals no other, so
    factors that reach beyond the end are alone in their class. ``limit`` is
    the longest period of interest at each place.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray, limit: np.ndarray, ends: np.ndarray) -> None:
        n = len(words)
        self.n, self.limit = n, limit
        key = text * (int(words.max(initial=0)) + 1) + words
        self.order = np.argsort(key, kind="stable")
        ordered = key[self.order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        begins = np.flatnonzero(new)
        self.begin, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.begin[: len(begins)], self.size[: len(begins)] = begins, np.diff(np.concatenate([begins, [n]]))
        self.classes = len(begins)
        self.cls, self.slot = np.empty(n, np.int64), np.empty(n, np.int64)
        self.cls[self.order] = np.cumsum(new) - 1
        self.slot[self.order] = np.arange(n)
        self.next, self.before = np.full(n, -1), np.full(n, -1)
        joined = np.flatnonzero(~new)
        self.next[self.order[joined - 1]], self.before[self.order[joined]] = self.order[joined], self.order[joined - 1]
        self.leaves = np.zeros(n, bool)
        # All but a largest class of each text part the others.
        owner, sizes = text[self.order[begins]], self.size[: len(begins)]
        turn = np.lexsort((sizes, owner))
        largest = np.concatenate([owner[turn][1:] != owner[turn][:-1], [True]])
        parts = np.ones(len(begins), bool)
        parts[turn[largest]] = False
        self.splitters = np.flatnonzero(parts[self.cls])

    def refine(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Go from ``length`` to one word more; returns pairs of places that have become neighbours."""
        nothing = np.zeros(0, np.int64)
        by = self.splitters
        by = by[(self.limit[by] > length) & (by > 0)]
        place = by - 1
        some = self.size[self.cls[place]] > 1
        place, by = place[some], by[some]
        self.splitters = nothing
        if not len(place):
            return nothing, nothing
        # Groups: places of one class whose next places are of one class.
        old, part = self.cls[place], self.cls[by]
        turn = np.lexsort((place, part, old))
        place, old, part = place[turn], old[turn], part[turn]
        head = np.concatenate([[True], (old[1:] != old[:-1]) | (part[1:] != part[:-1])])
        heads = np.flatnonzero(head)
        sizes, owner = np.diff(np.concatenate([heads, [len(place)]])), old[heads]
        # Of each class: how many of its places are in groups, how many groups, and what stays.
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        moved = np.add.reduceat(sizes, first)
        groups = np.diff(np.concatenate([first, [len(owner)]]))
        names = owner[first]
        stays = self.size[names] - moved
        which = np.repeat(np.arange(len(names)), groups)  # of a group, its class
        # Where no place stays, the first group keeps the class's name.
        keeps = np.zeros(len(owner), bool)
        keeps[first[stays == 0]] = True
        label = owner.copy()
        fresh = np.flatnonzero(~keeps)
        label[fresh] = self.classes + np.arange(len(fresh))
        self.classes += len(fresh)
        group = np.cumsum(head) - 1
        goes = ~keeps[group]
        place, old, group = place[goes], old[goes], group[goes]
        if not len(place):
            return nothing, nothing
        gone = np.bincount(which[fresh], weights=sizes[fresh], minlength=len(names)).astype(np.int64)
        self._move(place, names, gone)
        left, right = self._unlink(place, old)
        self.size[names] -= gone
        # The new classes are what has been moved to the ends of their old slices, group by group.
        counts = sizes[fresh]
        ends = np.cumsum(counts)
        base = self.begin[names] + self.size[names]
        start = np.concatenate([[0], np.cumsum(gone)])[:-1]
        self.begin[label[fresh]] = base[which[fresh]] + (ends - counts) - start[which[fresh]]
        self.size[label[fresh]] = counts
        self.cls[place] = label[group]
        same = np.flatnonzero(group[1:] == group[:-1])
        self.next[place], self.before[place] = -1, -1
        self.next[place[same]], self.before[place[same + 1]] = place[same + 1], place[same]
        # The smaller halves part others next: all children but a largest one of each class.
        children = np.concatenate([label[fresh], names])
        parent = np.concatenate([which[fresh], np.arange(len(names))])
        real = np.concatenate([np.ones(len(fresh), bool), gone > 0])
        children, parent = children[real], parent[real]
        turn = np.lexsort((self.size[children], parent))
        largest = np.concatenate([parent[turn][1:] != parent[turn][:-1], [True]])
        smaller = children[turn[~largest]]
        self.splitters = self.order[ranges(self.begin[smaller], self.begin[smaller] + self.size[smaller])]
        return np.concatenate([left, place[same]]), np.concatenate([right, place[same + 1]])

    def _move(self, place: np.ndarray, names: np.ndarray, gone: np.ndarray) -> None:
        """Put the places, given class by class, at the ends of their classes' slices in the same order."""
        tail_end = self.begin[names] + self.size[names]
        tail = ranges(tail_end - gone, tail_end)
        self.leaves[place] = True
        holders = self.order[tail]
        stay = holders[~self.leaves[holders]]  # what must make room, class by class
        vacated = self.slot[place]
        vacated = vacated[vacated < np.repeat(tail_end - gone, gone)]
        self.order[vacated], self.slot[stay] = stay, vacated
        self.order[tail], self.slot[place] = place, tail

    def _unlink(self, place: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take places out of the lists of their classes; returns the pairs that close up."""
        sorted_ = place[np.lexsort((place, old))]
        before, after = self.before[sorted_], self.next[sorted_]
        starts = (before < 0) | ~self.leaves[before]
        stops = (after < 0) | ~self.leaves[after]
        left, right = before[starts], after[stops]
        self.leaves[place] = False
        self.next[left[left >= 0]] = right[left >= 0]
        self.before[right[right >= 0]] = left[right >= 0]
        both = (left >= 0) & (right >= 0)
        return left[both], right[both]


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> tuple[np.ndarray, ...]:
    """All runs of several texts: text, start, length, period, by text, start and period.

    ``words`` are the words (whole numbers) of the texts one after the other,
    ``sizes`` how many each has. Neighbours of a class at a distance equal to
    its length are squares of primitive roots; squares of one period that
    start at places one after the other are one run.
    """
    texts = len(sizes)
    ends = np.cumsum(sizes + 1)
    closed = np.insert(words.astype(np.int64) + 1, np.cumsum(sizes), 0)  # a 0 after each text
    text = np.repeat(np.arange(texts), sizes + 1)
    begins = ends - sizes - 1
    limit = np.repeat(sizes // periods, sizes + 1)
    state = _Classes(closed, text, limit, ends - 1)
    squares, length, noted = [], 1, defaultdict(list)
    longest = int(limit.max(initial=0))
    everywhere = np.arange(len(closed))

    def note(left: np.ndarray, gap: np.ndarray) -> None:
        turn = np.argsort(gap, kind="stable")
        left, gap = left[turn], gap[turn]
        cuts = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        for some, first in zip(np.split(left, cuts), gap[np.concatenate([[0], cuts])].tolist(), strict=True):
            noted[first].append(some)

    while length <= longest:
        if length <= _LOOKED:
            found = np.flatnonzero(state.next - everywhere == length)
        else:
            found = np.unique(np.concatenate(noted.pop(length))) if length in noted else np.zeros(0, np.int64)
            found = found[state.next[found] - found == length]
        found = found[limit[found] >= length]
        if len(found):
            squares.append((found, np.full(len(found), length)))
        if length == _LOOKED:
            far = np.flatnonzero((state.next - everywhere > length) & (state.next >= 0))
            far = far[state.next[far] - far <= limit[far]]
            if len(far):
                note(far, state.next[far] - far)
        left, right = state.refine(length)
        length += 1
        if length > _LOOKED and len(left):
            gap = right - left
            some = (gap >= length) & (gap <= limit[left])
            if some.any():
                note(left[some], gap[some])
        if not len(state.splitters) and length > _LOOKED:
            # Classes change no more; what is noted still stands.
            for gap in [g for g in noted if g >= length]:
                found = np.unique(np.concatenate(noted[gap]))
                found = found[state.next[found] - found == gap]
                squares.append((found, np.full(len(found), gap)))
            break
    if not squares:
        return (np.zeros(0, np.int64),) * 4
    place, period = (np.concatenate(x) for x in zip(*squares, strict=True))
    turn = np.lexsort((place, period))
    place, period = place[turn], period[turn]
    new = np.concatenate([[True], (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(place)]]) - 1
    start, period, size = place[first], period[first], place[last] - place[first] + 2 * period[first]
    good = size >= np.maximum(least, periods * period)
    start, period, size = start[good], period[good], size[good]
    owner = text[start]
    start = start - begins[owner]
    turn = np.lexsort((period, start, owner))
    return owner[turn], start[turn], size[turn], period[turn]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """Per document: id, runs (start, length, period; in words, by start and period), best run, collapsed text.

    Crochemore's refinement by smaller halves, over the words of many texts at
    a time in each task: O(n log n) places move for n words, and one step is
    taken for each length up to a text's n / ``periods``, for all its chunk at
    once. Texts are whole; one of more than ``CHUNK`` words is a chunk by
    itself, so memory is in proportion to it. ``collapsed`` has the words, a
    space between two, that no run holds after its first period; ``best`` is
    the run of the greatest length / period, then the smallest start, then the
    smallest period. A null or empty text has no words, no runs and an empty
    collapsed text. Repeated or null ids are rows like others.
    """
    prefer_small_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    run = "struct<start: long, length: long, period: long>"
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def finish(names: list, texts: list[list[bytes]], numbers: Numbers, parts: list[np.ndarray], id_kind: pa.DataType) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts], np.int64)
        owner, start, length, period = runs_of(np.concatenate(parts), sizes, least, periods)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int32)
        found = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], names=["start", "length", "period"])
        best, collapsed = [None] * len(texts), []
        for i, words in enumerate(texts):
            mine = slice(cuts[i], cuts[i + 1])
            if cuts[i] < cuts[i + 1]:
                each = list(zip(start[mine].tolist(), length[mine].tolist(), period[mine].tolist(), strict=True))
                top = max(each, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
                best[i] = dict(zip(("start", "length", "period"), top, strict=True))
                covered = np.zeros(len(words) + 1, np.int64)
                np.add.at(covered, start[mine] + period[mine], 1)
                np.add.at(covered, start[mine] + length[mine], -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(covered[:-1]) == 0).tolist()]
            collapsed.append(b" ".join(words))
        listed = pa.ListArray.from_arrays(pa.array(cuts), found)
        return pa.RecordBatch.from_arrays([pa.array(names, id_kind), listed, pa.array(best, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["id", "runs", "best", "collapsed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, numbers, parts, held, id_kind = [], [], Numbers(), [], 0, None
        for batch in batches:
            id_kind = batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), strict=True):
                words = (text or b"").split()
                names.append(name)
                texts.append(words)
                parts.append(numbers.of(words))
                held += len(words) + 1
                if held >= CHUNK:
                    yield finish(names, texts, numbers, parts, id_kind)
                    names, texts, numbers, parts, held = [], [], Numbers(), [], 0
        if names:
            yield finish(names, texts, numbers, parts, id_kind)

    return chosen.mapInArrow(work, f"id {type_of(docs, id_col)}, runs array<{run}>, best {run}, collapsed string")
