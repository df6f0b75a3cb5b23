"""Documents whose sets of word shingles are similar, joined exactly."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.llm.components import connected_components
from tallymart.llm.words import TextHashes, chunks, prefer_small_batches, texts_as_bytes, window_hashes
from tallymart.staging import stage, unstage

WIDTH, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Shingles ordered by their frequency; the others are rarer than these and stand first. A bound on what is broadcast, 1 MB.
ORDERED = 131_072
#: Of n shingles n / MARGIN more are posted than one shared would need, so that so many must be shared.
MARGIN = 20
#: Times that classes sharing too few of their shingles are left out, which makes others share fewer.
NARROWINGS = 2
#: Times that members of a token that are still apart meet one of them, before all that remain meet each other.
TURNS = 1
#: Rows of a tile: groups of candidates are compared tile against tile.
TILE = 512
#: Texts that a task has met are not posted again, of so many it remembers.
_REMEMBERED = 1 << 17
_FLUSH = 1_500_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_sets(texts: list[bytes | None], hashes: TextHashes, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles, A-Z in lower case; a text with fewer words is one shingle."""
    found = []
    for some in chunks([(t or b"").translate(_LOWER) for t in texts]):
        words, begins = hashes.of(some)
        windows = window_hashes(words, width)
        for i, text in enumerate(some):
            first, last = int(begins[i]), int(begins[i + 1])
            if last - first >= width:
                ordered = np.sort(windows[first : last - width + 1])
                new = np.empty(len(ordered), bool)
                new[0] = True
                np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
                found.append(ordered if new.all() else ordered[new])
            elif last > first:
                found.append(np.array([int.from_bytes(blake2b(b" ".join(text.split()), digest_size=8, person=b"short").digest(), "little")], np.uint64))
            else:
                found.append(np.empty(0, np.uint64))
    return found


def shared_at_least(n: Column | int, num: int, den: int) -> Column | int:
    """How many of its posted shingles a set of size n shares with any that is similar to it."""
    least = F.floor((num * n + den - 1) / den / MARGIN)
    return F.greatest(F.lit(1), least)


def posted(n: int, num: int, den: int) -> int:
    """How many shingles a set of size n posts."""
    return min(n, n - -(-num * n // den) + max(1, n // MARGIN))


def class_of(found: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets, and with its size beside it only those, have equal names."""
    return int.from_bytes(blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature_bits(size: int) -> int:
    """Bits of the signature of a set of this size: four times the power of two from 64 that is not below it, one for each size band."""
    return 4 * max(64, 1 << max(size - 1, 0).bit_length())


def signature(found: np.ndarray) -> np.ndarray:
    """Parities of the shingles by the low bits of their hashes, as 64-bit words.

    A shingle that only one of two sets has changes one bit, so the sets
    differ in as many shingles as their signatures in bits, at least. A longer
    signature is halved by XOR of its halves.
    """
    bits = signature_bits(len(found))
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _picked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    prefer_small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def _summaries(docs: DataFrame, width: int) -> DataFrame:
    """A row for each document ``(id, n, class)``, and rows with a null n for shingles met more than once in a task: ``(times, null, shingle)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, count = TextHashes(), [], 0

        def often() -> Iterator[pa.RecordBatch]:
            if held:
                found, times = np.unique(np.concatenate(held), return_counts=True)
                more = times > 2
                yield pa.RecordBatch.from_arrays([pa.array(times[more].astype(np.int64)), pa.nulls(int(more.sum()), pa.int64()), pa.array(found[more].view(np.int64))], ["id", "n", "class"])

        for batch in batches:
            sets = shingle_sets(texts_as_bytes(batch.column(1)), hashes, width)
            held += sets
            count += sum(map(len, sets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64())], ["id", "n", "class"])
            if count > _FLUSH:
                yield from often()
                held, count = [], 0
        yield from often()

    return docs.mapInArrow(run, "id long, n long, class long")


def _postings(docs: DataFrame, often: np.ndarray, width: int, num: int, den: int) -> DataFrame:
    """``(token, class)``: of each set the first shingles in the common order.

    Sets that share ``ceil(t * n)`` of n shingles share k of the first
    ``n - ceil(t * n) + k``; k is n / MARGIN, one at least. The order: shingles that are not in ``often`` by
    their hash, then those of ``often``, the most frequent last.
    """
    by_hash = np.argsort(often)
    sorted_often, place = often[by_hash], by_hash  # place: 0 is the most frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, met = TextHashes(), set()
        for batch in batches:
            tokens, classes, lengths = [], [], []
            for found in shingle_sets(texts_as_bytes(batch.column(1)), hashes, width):
                name = class_of(found)
                if not len(found) or name in met:
                    continue
                if len(met) >= _REMEMBERED:
                    met.clear()
                met.add(name)
                take = posted(len(found), num, den)
                if len(sorted_often):
                    at = np.minimum(np.searchsorted(sorted_often, found), len(sorted_often) - 1)
                    known = sorted_often[at] == found
                    rare = found[~known]
                    if len(rare) >= take:
                        first = rare[:take]
                    else:
                        first = np.concatenate([rare, found[known][np.argsort(-place[at[known]])][: take - len(rare)]])
                else:
                    first = found[:take]
                tokens.append(first)
                classes.append(name)
                lengths.append(take)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(classes, np.int64), lengths))], ["token", "class"])

    return docs.mapInArrow(run, "token long, class long")


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """``(class, id, n, bits, shingles)`` of documents that stand for their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TextHashes()
        for batch in batches:
            sets = shingle_sets(texts_as_bytes(batch.column(1)), hashes, width)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], longs), pa.array([s.view(np.int64) for s in sets], longs)], ["class", "id", "n", "bits", "shingles"])

    return docs.mapInArrow(run, "class long, id long, n long, bits array<bigint>, shingles array<bigint>")


def _halved(bits: Column) -> Column:
    half = (F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda a, b: a.bitwiseXOR(b))


def _may_link(num: int, den: int) -> Column:
    """Whether sizes and signatures of a pair (n and m, bits and others) leave room for the similarity asked for.

    Sets of n and m shingles that differ in d have (n + m - d) / 2 in common
    and (n + m + d) / 2 together, and d is at least the bits that differ.
    Similar sets lie in the same size band or in neighbouring ones.
    """
    a = F.when(F.size("bits") > F.size("others"), _halved(F.col("bits"))).otherwise(F.col("bits"))
    b = F.when(F.size("others") > F.size("bits"), _halved(F.col("others"))).otherwise(F.col("others"))
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    both = F.col("n") + F.col("m")
    return (den * F.least("n", "m") >= num * F.greatest("n", "m")) & (den * (both - differ) >= num * (both + differ))


def _verified(pairs: DataFrame, signatures: DataFrame, num: int, den: int) -> DataFrame:
    """``(u, v)``: ids of the pairs of classes (a, b) that link, by signatures and then by their sorted shingles."""
    small = signatures.select("class", "n", _halved(_halved(F.col("bits"))).alias("bits"))
    left = small.select(F.col("class").alias("a"), "n", "bits")
    right = small.select(F.col("class").alias("b"), F.col("n").alias("m"), F.col("bits").alias("others"))
    likely = pairs.join(left, "a").join(right, "b").filter(_may_link(num, den)).select("a", "b")
    full = likely.join(signatures.select(F.col("class").alias("a"), F.col("id").alias("u"), F.col("shingles").alias("s")), "a").join(signatures.select(F.col("class").alias("b"), F.col("id").alias("v"), F.col("shingles").alias("t")), "b").select("u", "v", "s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (c.values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (s, t))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return full.mapInArrow(run, "u long, v long")


def _shared(postings: DataFrame) -> DataFrame:
    """Postings of tokens that more than one class has, with the least and the greatest of their classes."""
    token = Window.partitionBy("token")
    return postings.withColumns({"low": F.min("class").over(token), "high": F.max("class").over(token)}).filter("low <> high")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """``(id, n_shingles, component_id)``: each document with the least id that it reaches by links.

    Two documents link when ``den * |A & B| >= num * |A | B|`` of their sets
    of ``width``-word shingles. A null or empty text, or one without words,
    has an empty set and links with nothing; equal texts link; repeated rows
    give repeated rows; an empty table gives none; ids must not be null.

    1. Texts become sets of hashes; equal sets are one class. 2. Each class
    posts the first shingles in the common order, rarest first. Tokens of one
    class are dropped, and then classes that share fewer tokens with others
    than they would with a similar set. 3. The members of
    a token meet its two outermost classes (by their random names), which
    joins groups of copies by as many pairs as they have members; where the
    members of a token are still apart, they meet one of them that the token
    picks, in some turns. 4. Members of a token that are then still apart meet
    each other, in tiles by size. Every
    pair passes its size band, then the bit count of the signatures, then the
    exact intersection. No link between different components is left untested.
    """
    docs = _picked(df, id_col, text_col)
    summaries = stage(_summaries(docs, width), "summaries")
    classes = summaries.filter("n is not null")
    top = summaries.filter("n is null").groupBy("class").agg(F.sum("id").alias("times")).orderBy(F.desc("times"), "class").limit(ORDERED).collect()
    often = np.array([r["class"] for r in top], np.int64).view(np.uint64)
    token = Window.partitionBy("token")
    named = stage(classes.filter("n > 0").groupBy("class", "n").agg(F.min("id").alias("id")), "named")
    shared = stage(_shared(_postings(docs, often, width, num, den)).distinct(), "postings")
    for _ in range(NARROWINGS):
        enough = shared.groupBy("class").agg(F.count("*").alias("tokens")).join(named, "class").filter(F.col("tokens") >= shared_at_least(F.col("n"), num, den)).select("class").distinct()
        narrowed = stage(_shared(shared.select("token", "class").join(enough, "class", "left_semi")), "postings")
        unstage(shared)
        shared = narrowed
    standing = stage(named.join(shared.select("class").distinct(), "class", "left_semi").select("id"), "standing")
    signatures = stage(_signatures(docs.join(standing, "id", "left_semi"), width), "signatures")
    unstage(standing)
    outer = shared.select(F.col("class").alias("a"), F.explode(F.array("low", "high")).alias("b")).filter("a <> b")
    first = outer.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stage(_verified(first, signatures, num, den), "links")
    joined = connected_components(links)

    others = shared.filter((F.col("class") != F.col("low")) & (F.col("class") != F.col("high"))).select("token", "class")
    for turn in range(TURNS + 1):
        apart = signatures.select("class", "id").join(joined, F.col("id") == F.col("node"), "left").select("class", F.coalesce("component", "id").alias("component"))
        members = others.join(apart, "class").withColumns({"least": F.min("component").over(token), "most": F.max("component").over(token)})
        split = stage(members.filter("least <> most").select("token", "class", "component"), "split")
        if not split.head(1):
            unstage(split)
            break
        if turn < TURNS:
            chosen = F.min(F.struct(F.xxhash64("class", "token", F.lit(turn)), "class", "component")).over(token)
            met = split.withColumn("chosen", chosen).filter(F.col("component") != F.col("chosen.component"))
            pairs = met.select(F.least("class", "chosen.class").alias("a"), F.greatest("class", "chosen.class").alias("b")).distinct()
        else:
            pairs = _pairs_in_tiles(split.join(signatures.select("class", "n", "bits"), "class"), num, den).distinct()
        more, before = stage(links.unionByName(_verified(pairs, signatures, num, den)), "links"), (links, split, joined)
        links, joined = more, connected_components(more)
        for done in before:
            unstage(done)
    for done in (links, shared, signatures):
        unstage(done)

    answer = named.join(joined, F.col("id") == F.col("node"), "left").select("class", "n", F.coalesce("component", "id").alias("component"))
    return classes.join(answer, ["class", "n"], "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _pairs_in_tiles(members: DataFrame, num: int, den: int) -> DataFrame:
    """``(a, b)``: classes of a token in different components that sizes and signatures let link.

    A token's members are cut into tiles by size; tiles of a token meet in
    pairs, each pair in a group of its own of two tiles at most.
    """
    order = Window.partitionBy("token").orderBy("n", "class")
    placed = members.withColumn("tile", F.floor((F.row_number().over(order) - 1) / TILE).cast("int")).withColumn("last", F.max("tile").over(Window.partitionBy("token")))
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("last")), lambda other: F.struct(F.least(other, F.col("tile")).alias("low"), F.greatest(other, F.col("tile")).alias("high"))))
    grouped = placed.withColumn("pair", meets).select("token", "pair.low", "pair.high", "tile", "class", "n", "bits", "component")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        tile = group.column("tile").to_numpy()
        name, n, comp = (group.column(c).to_numpy() for c in ("class", "n", "component"))
        bits = [np.array(b, np.int64).view(np.uint64) for b in group.column("bits").to_pylist()]
        rows, cols = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        found_a, found_b = [], []
        by_width: dict[int, np.ndarray] = {}

        def at_width(words: int) -> np.ndarray:
            if words not in by_width:
                table = np.zeros((len(bits), words), np.uint64)
                for i, b in enumerate(bits):
                    while len(b) > words:
                        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
                    if len(b) == words:
                        table[i] = b
                by_width[words] = table
            return by_width[words]

        for i in rows:
            fits = cols[(comp[cols] != comp[i]) & (den * np.minimum(n[cols], n[i]) >= num * np.maximum(n[cols], n[i]))]
            if low == high:
                fits = fits[fits > i]
            for words in {min(len(bits[i]), len(bits[j])) for j in fits}:
                some = fits[[min(len(bits[i]), len(bits[j])) == words for j in fits]]
                table = at_width(words)
                differ = np.bitwise_count(table[some] ^ table[i]).sum(axis=1, dtype=np.int64)
                both = n[some] + n[i]
                some = some[den * (both - differ) >= num * (both + differ)]
                found_a += [name[i]] * len(some)
                found_b += name[some].tolist()
        a, b = np.array(found_a, np.int64), np.array(found_b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return grouped.groupBy("token", "low", "high").applyInArrow(run, "a long, b long")
