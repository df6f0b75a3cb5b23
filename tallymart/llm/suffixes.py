"""Decontamination by suffix arrays over shards of the training texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tallymart.llm.rows import with_row_names
from tallymart.llm.terms import Numbers, query_blocks, ranges, term_lists, terms, type_of
from tallymart.llm.words import prefer_small_batches, texts_as_bytes
from tallymart.staging import stage

#: Consecutive words of a test item that make a leak.
WINDOW = 10
#: Words of a shard; words of the test set that go to the tasks at once.
SHARD, BLOCK_WORDS = 1 << 20, 1 << 18
#: Types of item ids as they are; any other goes as a string.
_ITEMS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places ordered by the ``depth`` words (numbers from 0) that start there; what follows the end sorts first.

    As many words as fit 63 bits are compared at once, and then, by doubling,
    only among places that still tie.
    """
    n = len(words)
    bits = max(int(words.max(initial=0)) + 1, 1).bit_length()
    step = min(63 // bits, depth)
    padded = np.concatenate([words + 1, np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(step):
        key = key << bits | padded[i : i + n]
    order = np.argsort(key)
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])[:n]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while step < depth:
        single = new & np.concatenate([new[1:], [True]])[:n]
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        held = order[slots]
        after = held + step
        key = rank[held] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        turn = np.argsort(key)
        held, key = held[turn], key[turn]
        order[slots] = held
        differs = np.concatenate([[True], key[1:] != key[:-1]])
        new[slots] = differs
        rank[held] = np.maximum.accumulate(np.where(differs, slots, 0))
        step *= 2
    return order


def _bound(words: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, ahead: int, wanted: np.ndarray, after: bool) -> np.ndarray:
    """By halving, the first slot of each range whose word ``ahead`` of its place is not below (or is ``after``) the wanted one."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        word = words[order[middle] + ahead]
        right = word <= wanted[open_] if after else word < wanted[open_]
        low[open_] = np.where(right, middle + 1, low[open_])
        high[open_] = np.where(right, high[open_], middle)
        open_ = open_[low[open_] < high[open_]]
    return low


class _Tests:
    """The words of a block of test items one after the other, and its windows."""

    def __init__(self, block: list[Row], window: int) -> None:
        self.names = [q["item"] for q in block]
        self.words = [w.encode() for q in block for w in q["words"]]
        sizes = np.array([len(q["words"]) for q in block], np.int64)
        begins = np.cumsum(sizes) - sizes
        width = np.minimum(sizes, window)
        counts = np.where(sizes > 0, sizes - width + 1, 0)
        self.start = ranges(begins, begins + counts)
        self.item, self.width = np.repeat(np.arange(len(block)), counts), np.repeat(width, counts)
        self.at = self.start - np.repeat(begins, counts)

    def places_in(self, words: np.ndarray, numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
        """Which windows stand where in a shard: a window and a place for each occurrence."""
        width = int(self.width.max(initial=0))
        order = suffix_array(words, max(width, 1))
        words = np.concatenate([words, np.zeros(width, np.int64)])
        asked = np.fromiter((numbers.get(w, -1) for w in self.words), np.int64, len(self.words))
        live, low, high = np.arange(len(self.start)), np.zeros(len(self.start), np.int64), np.full(len(self.start), len(order))
        which, begins, ends = [], [], []
        for ahead in range(width):
            wanted = asked[self.start[live] + ahead]
            some = wanted > 0
            live, low, high, wanted = live[some], low[some], high[some], wanted[some]
            low, high = _bound(words, order, low, high, ahead, wanted, False), _bound(words, order, low, high, ahead, wanted, True)
            some = low < high
            live, low, high = live[some], low[some], high[some]
            done = self.width[live] == ahead + 1
            which.append(live[done])
            begins.append(low[done])
            ends.append(high[done])
            live, low, high = live[~done], low[~done], high[~done]
        which, begins, ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (which, begins, ends))
        return np.repeat(which, ends - begins), order[ranges(begins, ends)]


def _matches(tests: _Tests, doc: np.ndarray, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Longest verbatim matches (doc, item, place in the item, place, words), from occurrences that follow each other in both texts."""
    item, at, width = tests.item[window], tests.at[window], tests.width[window]
    turn = np.lexsort((place, place - at, item, doc))
    doc, item, at, width, place = (x[turn] for x in (doc, item, at, width, place))
    once = np.ones(len(doc), bool)  # what stands in the overlap of two shards is found in both
    once[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1]) | (place[1:] != place[:-1])
    doc, item, at, width, place = (x[once] for x in (doc, item, at, width, place))
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] - at[1:] != place[:-1] - at[:-1]) | (place[1:] != place[:-1] + 1)
    start = np.flatnonzero(first)
    last = np.concatenate([start[1:], [len(doc)]])[: len(start)] - 1
    return doc[start], item[start], at[start], place[start], place[last] - place[start] + width[start]


def _scan(named: DataFrame, block: list[Row], item_type: str, window: int) -> DataFrame:
    """``named`` (row, id, text) with each text's number of words and its matches with the block's items."""
    tests = _Tests(block, window)
    overlap = max(int(tests.width.max(initial=1)) - 1, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, names, counts = [], [], []  # of documents not handed on yet
        parts, held, numbers = [], 0, Numbers(1)  # of the shard: numbers of words, 0 between documents
        pieces, found, gone = [], [], 0  # (slot, document, its words before); occurrences; documents handed on

        def close() -> None:
            nonlocal parts, held, numbers, pieces
            if parts:
                which, slot = tests.places_in(np.concatenate(parts), numbers)
                begins, docs, before = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
                piece = np.searchsorted(begins, slot, "right") - 1
                found.append((docs[piece], which, slot - begins[piece] + before[piece]))
            parts, held, numbers, pieces = [], 0, Numbers(1), []

        def handed(kinds: list[pa.DataType]) -> pa.RecordBatch:
            nonlocal rows, names, counts, found, gone
            doc, which, place = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            doc, item, at, place, size = _matches(tests, doc - gone, which, place)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(rows)))]).astype(np.int32)
            items = pa.array([tests.names[i] for i in item.tolist()], item_kind)
            struct = pa.StructArray.from_arrays([items, *(pa.array(x.astype(np.int64)) for x in (at, place, size))], names=["item", "item_start", "start", "length"])
            out = pa.RecordBatch.from_arrays([pa.array(rows, kinds[0]), pa.array(names, kinds[1]), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), struct)], names=["row", "id", "n_words", "matches"])
            gone += len(rows)
            rows, names, counts, found = [], [], [], []
            return out

        kinds = None
        for batch in batches:
            kinds = [batch.column(0).type, batch.column(1).type]
            for row, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_as_bytes(batch.column(2)), strict=True):
                doc, n, tail = gone + len(rows), 0, []
                for some in term_lists(text or b""):
                    if not some:
                        continue
                    if held >= SHARD:
                        close()
                        some, n = tail + some, n - len(tail)
                    if not pieces or pieces[-1][1] != doc:
                        pieces.append((held, doc, n))
                    parts.append(numbers.of(some))
                    held += len(some)
                    n += len(some)
                    tail = (tail + some)[-overlap:] if overlap and len(some) < overlap else some[-overlap:] if overlap else []
                parts.append(np.zeros(1, np.int64))
                held += 1
                rows.append(row)
                names.append(name)
                counts.append(n)
                if held >= SHARD:
                    close()
                    yield handed(kinds)
        close()
        if rows:
            yield handed(kinds)

    item_kind = _ITEMS[item_type]
    kind = f"row long, id {type_of(named, 'id')}, n_words long, matches array<struct<item: {item_type}, item_start: long, start: long, length: long>>"
    return named.select("row", "id", "text").mapInArrow(run, kind)


def n_hit(matches: Column) -> Column:
    """Words that any of the matches covers."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["length"]).alias("stop"))))
    nothing = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, nothing, lambda a, s: F.struct(F.greatest(a["to"], s["stop"]).alias("to"), (a["n"] + F.greatest(s["stop"] - F.greatest(a["to"], s["start"]), F.lit(0))).alias("n")))["n"]


def find_leaks(docs: DataFrame, tests: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: id, n_words, matches (item, item_start, start, length; all in words), n_hit.

    Each task numbers the words of about ``SHARD`` words of its documents,
    orders their suffixes by as many words as a window has, and looks every
    suffix of the test items up by halving: those that start with a window are
    one stretch of the array. Occurrences that follow each other in both texts
    join into the longest verbatim matches. A window is ``window`` consecutive
    words of an item, or the whole of a shorter item. A document of more words
    than a shard is cut with an overlap of a window less one word. The test set
    goes to the tasks in blocks of at most ``BLOCK_WORDS`` words.

    Each row of either table counts by itself: ids may repeat or be null. Null
    texts and those without words hold nothing and are found nowhere.
    """
    prefer_small_batches(docs.sparkSession)
    kind = type_of(tests, item_col)
    kind = kind if kind in _ITEMS else "string"
    items = tests.select(F.col(item_col).cast(kind).alias("item"), terms(F.col(item_text)).alias("words")).filter(F.size("words") > 0)
    blocks = query_blocks(items, lambda q: len(q["words"]), BLOCK_WORDS)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        named = docs.select(F.lit(0).cast("long").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        out = _scan(named, first, kind, window)
    else:
        placed, row = with_row_names(docs)
        named = placed.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        out = stage(_scan(named, first, kind, window), "matches")
        for block in (second, *blocks):
            more = _scan(named, block, kind, window).filter(F.size("matches") > 0).select("row", F.col("matches").alias("more"))
            both = F.when(F.col("more").isNull(), F.col("matches")).otherwise(F.concat("matches", "more"))
            out = stage(out.join(more, "row", "left").withColumn("matches", both).drop("more"), "matches")
    return out.select("id", "n_words", "matches", n_hit(F.col("matches")).alias("n_hit"))


def remove_leaks(docs: DataFrame, tests: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs``, in all their columns, without those that hold a window of a test item; cases as in ``find_leaks``."""
    placed, row = with_row_names(docs)
    bare = placed.select(F.col(row).alias("id"), F.col(text_col).alias("text"))
    leaks = find_leaks(bare, tests, window, "id", "text", item_col, item_text).filter(F.col("n_hit") > 0)
    return placed.join(leaks.select(F.col("id").alias(row)), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
