"""SentencePiece encoding with source offsets, and decoding."""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator, Sequence
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tallymart.llm.words import prefer_small_batches, texts_as_bytes

SPACE = "▁"
_BAD = "�"
#: Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_MEMO = 1 << 17
_PARTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
#: Words up to so many characters are merged side by side, those of like lengths together.
_WIDTHS = (8, 12, 16, 24, 40)
#: Bytes of text that are worked on at once; a longer text is cut before spaces.
_PART = 1 << 19
_NOT_SPACE = re.compile(rb"[^ ]").search
_NEVER = np.int32(1 << 30)


class CharacterMap:
    """The compiled map of a model: a double-array trie of prefixes, each leading to its replacement."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]
        #: Bytes that some prefix of the map begins with.
        self.begins = np.zeros(256, bool)
        if self.units:
            root = self._offset(self.units[0])
            self.begins[[b for b in range(256) if root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b]] = True

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes | None]:
        """Length of the longest prefix of ``text`` from ``at`` that the map has, and its replacement."""
        best, replacement = 0, None
        if not self.units:
            return best, replacement
        node = self._offset(self.units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                place = self.units[node] & 0x7FFFFFFF
                best, replacement = i + 1 - at, self.replacements[place : self.replacements.index(b"\0", place)]
        return best, replacement

    def applied(self, text: bytes) -> tuple[bytes, np.ndarray | None]:
        """The text with its longest prefixes replaced from left to right, and of each byte and the end the byte it comes from; None: all stay.

        Only where a prefix can begin is the map looked up; the rest is copied with its places.
        """
        out, source, done = [], [], 0
        for at in np.flatnonzero(self.begins[np.frombuffer(text, np.uint8)]).tolist():
            if at < done:
                continue
            length, new = self.longest(text, at)
            if length:
                out += [text[done:at], new]
                source += [np.arange(done, at), np.full(len(new), at)]
                done = at + length
        if not out:
            return text, None
        return b"".join([*out, text[done:]]), np.concatenate([*source, np.arange(done, len(text) + 1)])


@cache
def piece_model(serialized: bytes) -> PieceModel:
    """The model, read once in each Python worker."""
    return PieceModel(serialized)


class PieceModel:
    """A BPE SentencePiece model read from its file; ``encode`` gives the ids that the library gives.

    Models of other types and those with user-defined or unused pieces are
    refused rather than encoded otherwise than the library would.
    """

    def __init__(self, serialized: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(serialized)
        if proto.trainer_spec.model_type != 2 or any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces) or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with white space before words and without user-defined or unused pieces are supported")
        self.pieces = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.rank = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces)}
        self.bytes_at = [self.ids[f"<0x{b:02X}>"] for b in range(256)] if proto.trainer_spec.byte_fallback else None
        self.unknown = kinds.index(UNKNOWN)
        self.begin, self.end = self.ids.get(proto.trainer_spec.bos_piece, -1), self.ids.get(proto.trainer_spec.eos_piece, -1)
        spec = proto.normalizer_spec
        self.characters = CharacterMap(spec.precompiled_charsmap)
        self.dummy_prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        surface = proto.trainer_spec.unk_surface if proto.trainer_spec.HasField("unk_surface") else " ⁇ "
        #: What an id decodes to: bytes of a piece, b"" for control pieces; byte pieces apart, by value.
        self.decoded = [b"" if k == CONTROL else surface.encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.byte_value = {self.ids[f"<0x{b:02X}>"]: b for b in range(256)} if self.bytes_at else {}
        self.byte_ids = np.zeros(len(self.pieces), bool)
        self.byte_ids[list(self.byte_value)] = True
        self.kinds = kinds
        #: Characters before which a word may be cut off: no piece has the space mark after another character.
        inside = any(SPACE in p.lstrip(SPACE) for p in self.rank)
        self.cuts = self.escape and not inside
        self.memo: dict[str, bytes] = {}
        each = [bytes((self.byte_value[i],)) if i in self.byte_value else d for i, d in enumerate(self.decoded)]
        self.decoded_bytes, self.decoded_size = np.frombuffer(b"".join(each), np.uint8), np.array([len(d) for d in each])
        self.decoded_at = np.cumsum(self.decoded_size) - self.decoded_size
        self.marked = np.array([p.startswith(SPACE) for p in self.pieces])
        self._merger()

    def normalize(self, text: bytes) -> tuple[bytes, list[int]]:
        """The normalised text and, for each of its bytes and its end, the byte of ``text`` it comes from.

        From left to right the longest prefix that the character map has is
        replaced, another character is kept, and a byte that is not UTF-8
        becomes U+FFFD. Then spaces are squeezed and marked as the model says.
        """
        mark = SPACE.encode() if self.escape else b" "
        out, source, at = bytearray(), [], 0

        def emit(piece: bytes, start: int) -> None:
            out.extend(piece)
            source.extend([start] * len(piece))

        steps: list[tuple[bytes, int, int]] = []
        while at < len(text):
            length, new = self.characters.longest(text, at)
            if not length:
                length = _utf8_length(text, at)
                new = text[at : at + length] if length else _BAD.encode()
                length = length or 1
            steps.append((new, at, at + length))
            at += length
        if self.squeeze:
            while steps and not steps[0][0].strip(b" "):
                steps.pop(0)
        if not steps:
            return b"", [len(text)]
        if self.dummy_prefix:
            emit(mark, steps[0][1])
        spaced = self.squeeze
        for new, start, _ in steps:
            if spaced:
                new = new.lstrip(b" ")
            if new:
                for byte in new:
                    emit(mark if byte == 0x20 else bytes((byte,)), start)
                spaced = self.squeeze and new.endswith(b" ")
        end = steps[-1][2]
        if self.squeeze:
            while out.endswith(mark):
                end = source[len(out) - len(mark)]
                del out[-len(mark) :], source[-len(mark) :]
        return bytes(out), [*source, end]

    def _merger(self) -> None:
        """Tables to merge by numbers: of each character, of each two symbols that join, and of each symbol its id and bytes.

        Symbols are numbered like pieces; characters that are none but occur
        in one, or have a byte piece, follow.
        """
        first = len(self.pieces)
        number = {p: self.ids[p] for p in self.rank}
        others = {c for p in self.rank for c in p} | ({chr(b) for b in range(1, 128)} if self.bytes_at else set())
        for c in sorted(others - set(number)):
            number[c] = first = first + 1
        self.pad, self.strange = first + 1, first + 2
        self.number_of = np.full(0x110000, self.strange, np.int32)
        for c in others:
            self.number_of[ord(c)] = number[c]
        self.number_of[0] = self.pad
        self.row_id, self.row_size = np.zeros(first + 1, np.uint32), np.zeros(first + 1, np.uint32)
        self.whole = np.zeros(first + 3, bool)  # symbols that are one piece
        for text, n in number.items():
            size = len(text.encode())
            self.row_size[n] = size
            if text in self.rank:
                self.row_id[n], self.whole[n] = self.ids[text], True
            elif size == 1 and self.bytes_at:
                self.row_id[n], self.whole[n] = self.bytes_at[ord(text)], True
        self.whole[self.pad] = True
        order = {score: i for i, score in enumerate(sorted(set(self.rank.values())))}
        pairs = {}
        for piece, score in self.rank.items():
            for cut in range(1, len(piece)):
                a, b = number.get(piece[:cut]), number.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 24 | b] = (order[score], self.ids[piece])
        bits = max(10, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.pair_key, self.pair_rank, self.pair_made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NEVER, np.int32), np.zeros(1 << bits, np.int32)
        for key, (rank, made) in pairs.items():
            at = key * 0x9E3779B97F4A7C15 % (1 << 64) >> int(self.shift)
            while self.pair_key[at] >= 0:
                at = (at + 1) % (1 << bits)
            self.pair_key[at], self.pair_rank[at], self.pair_made[at] = key, rank, made

    def _joined(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (0 joins first) and number of the symbol that two symbols make; _NEVER where they make none."""
        key = a.astype(np.int64) << 24 | b
        at = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        rank, made, held = self.pair_rank[at], self.pair_made[at], self.pair_key[at]
        rest = np.nonzero((held != key) & (held >= 0))
        rank[held != key] = _NEVER
        while len(rest[0]):
            at[rest] = (at[rest] + 1) & (len(self.pair_key) - 1)
            held, where = self.pair_key[at[rest]], at[rest]
            hit = held == key[rest]
            found = tuple(r[hit] for r in rest)
            rank[found], made[found] = self.pair_rank[where[hit]], self.pair_made[where[hit]]
            rest = tuple(r[(held >= 0) & ~hit] for r in rest)
        return rank, made

    def _merged(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of symbols after merging, best score first and leftmost among equals, as ``(rows, symbols)`` of those that end together."""
        rows = np.arange(len(symbols))
        rank, made = self._joined(symbols[:, :-1], symbols[:, 1:])
        while True:
            if symbols.shape[1] < 2:
                yield rows, symbols
                return
            at = rank.argmin(axis=1)
            live = rank[np.arange(len(rows)), at] < _NEVER
            if not live.all():
                yield rows[~live], symbols[~live]
                rows, symbols, rank, made, at = rows[live], symbols[live], rank[live], made[live], at[live]
            if not len(rows):
                return
            each, left = np.arange(len(rows)), at[:, None]
            symbols[each, at] = made[each, at]
            places = np.arange(symbols.shape[1] - 1)[None, :]
            symbols = np.take_along_axis(symbols, places + (places > left), 1)
            places = places[:, :-1]
            beyond = places + (places > left)
            rank, made = np.take_along_axis(rank, beyond, 1), np.take_along_axis(made, beyond, 1)
            for near in (at - 1, at):
                some = np.flatnonzero((near >= 0) & (near < rank.shape[1]))
                where = near[some]
                rank[some, where], made[some, where] = self._joined(symbols[some, where], symbols[some, where + 1])

    def merge(self, word: str) -> list[str]:
        """The symbols of one word after merging, with a heap: for long words and those with characters no piece has."""
        symbols: list[str] = list(word)
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (made := symbols[left] + symbols[right]) in self.rank:
                heapq.heappush(heap, (self.rank[made], left, right, made))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, made = heapq.heappop(heap)
            if not symbols[left] or not symbols[right] or symbols[left] + symbols[right] != made or after[left] != right:
                continue
            symbols[left], symbols[right] = made, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s]

    def _ids_of(self, symbol: str) -> list[int]:
        if symbol in self.rank:
            return [self.ids[symbol]]
        return [self.bytes_at[b] for b in symbol.encode()] if self.bytes_at else [self.unknown]

    def _rows_of(self, word: str) -> bytes:
        """Of each piece of a word: its id, the bytes of the normalised text it moves on by, and those it stands for up to there.

        Byte pieces of one character stand for the whole of it; the first moves on.
        """
        rows: list[int] = []
        for s in self.merge(word):
            size, ids = len(s.encode()), self._ids_of(s)
            if ids[0] == self.unknown and rows and rows[-3] == self.unknown:
                rows[-2], rows[-1] = rows[-2] + size, rows[-1] + size
                continue
            for k, i in enumerate(ids):
                rows += (i, 0 if k else size, size)
        return struct.pack(f"<{len(rows)}I", *rows)

    def _learned(self, words: list[str]) -> list[bytes]:
        """What ``_rows_of`` gives for each word; words of like lengths are merged side by side."""
        found: list[bytes | None] = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in _WIDTHS:
            some = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            if not len(some):
                continue
            symbols = self.number_of[np.array([words[i] for i in some.tolist()], f"<U{width}").view(np.uint32).reshape(len(some), width)]
            for rows, ended in self._merged(symbols):
                good = self.whole[ended].all(axis=1) & ((ended != self.pad).any(axis=1))
                rows, ended = rows[good], ended[good]
                held = ended != self.pad
                flat = ended[held]
                size = self.row_size[flat]
                packed = np.column_stack([self.row_id[flat], size, size]).astype("<u4").tobytes()
                ends = (12 * np.cumsum(held.sum(axis=1))).tolist()
                for i, begin, end in zip(some[rows].tolist(), [0, *ends][:-1], ends, strict=True):
                    found[i] = packed[begin:end]
        return [self._rows_of(words[i]) if f is None or "\0" in words[i] else f for i, f in enumerate(found)]

    def _recalled(self, words: list[str]) -> list[bytes]:
        """The same, remembered for words met before; as many as the memo holds."""
        known = list(map(self.memo.get, words))
        missing = list({w for w, k in zip(words, known, strict=True) if k is None})
        if missing:
            new = dict(zip(missing, self._learned(missing), strict=True))
            known = [new[w] if k is None else k for w, k in zip(words, known, strict=True)]
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            self.memo.update((w, k) for w, k in new.items() if len(w) <= _WIDTHS[-1])
        return known

    def _words(self, normalized: str) -> list[str]:
        """Parts that no merge joins: each begins with its run of space marks."""
        if not self.cuts:
            return [normalized] if normalized else []
        return _PARTS(normalized)

    def align(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a UTF-8 text, with begin and end ids, and ``(begin, end)`` of each piece between those two, in bytes of the text as it was given."""
        made, source = self.normalize(text)
        source = np.array(source, np.int64)
        body = np.frombuffer(b"".join(self._recalled(self._words(made.decode()))), "<u4").reshape(-1, 3)
        ids = np.concatenate([[self.begin], body[:, 0], [self.end]]).astype("<u4")
        ends = np.cumsum(body[:, 1], dtype=np.int64)
        return ids, np.column_stack([source[ends - body[:, 2]], source[ends]]).astype("<i8")

    def _plain(self, text: bytes) -> bool:
        """Whether words are what stands between runs of spaces, each with the run before it, so that many texts can be cut at once."""
        if not self.cuts or self.squeeze or not self.dummy_prefix or SPACE.encode() in text:
            return False
        try:
            text.decode()
        except UnicodeDecodeError:
            return False
        return True

    def _parts(self, texts: list[bytes]) -> Iterator[list[tuple[int, bytes, np.ndarray | None, int]]]:
        """Texts through the character map, in lists of about _PART bytes: number, normalised bytes after a space, their sources, place of the first.

        The space before a part is the dummy prefix or the one the text was cut at.
        """
        some, held = [], 0
        for number, text in enumerate(texts):
            made, source = self.characters.applied(text)
            if not self._plain(made):
                yield [(number, text, None, -1)]
                continue
            at = 0
            while at < len(made):
                end = _cut(made, at)
                some.append((number, made[at:end], None if source is None else source[max(at - 1, 0) : end + 1], at))
                held += end - at
                at = end + 1
                if held >= _PART:
                    yield some
                    some, held = [], 0
        if some:
            yield some

    def encoded(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
        """``(number, ids, places, decoded)`` of the texts' parts, those of a text in order.

        ``ids`` are without begin and end ids, ``places`` the begin and end of
        each piece in bytes of the text as it was given, and ``decoded`` what
        the ids decode to. Texts without bytes do not appear.

        A text goes through the character map, which records where each byte
        comes from, then every space becomes a mark. Words are cut at the
        marks, distinct ones merged, and their pieces laid out again for all
        words; running sums of the pieces' sizes look up their sources.
        """
        for parts in self._parts(texts):
            number, text, _, at = parts[0]
            if at < 0:
                ids, places = self.align(text)
                yield number, ids[1:-1], places, self.decode(ids)
                continue
            cut = pc.split_pattern(pa.array([p for _, p, _, _ in parts], pa.binary()).cast(pa.string()), " ")
            words, offsets = _with_runs(cut.flatten(), cut.offsets.to_numpy())
            coded = words.dictionary_encode()
            rows = self._recalled([SPACE + w for w in coded.dictionary.to_pylist()])
            table = np.frombuffer(b"".join(rows), "<u4").reshape(-1, 3)
            counts = np.fromiter(map(len, rows), np.int64, len(rows)) // 12
            codes = coded.indices.to_numpy()
            each = counts[codes]
            stops = np.cumsum(each)
            body = table[np.repeat((np.cumsum(counts) - counts)[codes] - (stops - each), each) + np.arange(stops[-1])]
            firsts = np.concatenate([[0], stops])[offsets]
            ids, places = body[:, 0], self._projected(parts, body, firsts)
            size = self.decoded_size[ids]
            ends = np.cumsum(size)
            out = self.decoded_bytes[np.repeat(self.decoded_at[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes()
            bounds = np.concatenate([[0], ends])[firsts].tolist()
            for j, (number, _, _, at) in enumerate(parts):
                first, last = int(firsts[j]), int(firsts[j + 1])
                decoded = out[bounds[j] + (at == 0 and self.marked[ids[first]]) : bounds[j + 1]]
                try:
                    decoded.decode()
                except UnicodeDecodeError:
                    decoded = self.decode(ids[first:last], at == 0)
                yield number, ids[first:last], places[first:last], decoded

    def _projected(self, parts: list, body: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Begin and end of each piece in the bytes of its text: its place in the normalised part, through the part's sources."""
        joined = np.frombuffer(b"".join([b" %b\0" % p for _, p, _, _ in parts]), np.uint8)
        sizes = np.array([len(p) + 2 for _, p, _, _ in parts])
        starts = np.cumsum(sizes) - sizes
        ats = np.array([at for *_, at in parts])
        source = np.arange(len(joined)) + np.repeat(ats - starts - 1, sizes)
        for (_, p, known, at), start in zip(parts, starts.tolist(), strict=True):
            if known is not None:
                source[start + (at == 0) : start + 2 + len(p)] = known
        source[starts] = np.maximum(source[starts], 0)  # a dummy prefix stands at the first byte
        width = np.where(joined == 0x20, len(SPACE.encode()), 1)
        wide = np.repeat(source, width)
        begins = (np.cumsum(width) - width)[starts]
        ends = np.cumsum(body[:, 1], dtype=np.int64)
        passed = np.concatenate([[0], ends])[firsts]
        ends += np.repeat(begins - passed[:-1], np.diff(firsts))
        return np.column_stack([wide[ends - body[:, 2]], wide[ends]]).astype("<i8")

    def encode(self, text: bytes) -> np.ndarray:
        """All ids of a UTF-8 text, with begin and end ids."""
        return self.align(text)[0]

    def spans(self, text: bytes) -> list[tuple[int, str, int, int]]:
        """``(id, piece, begin, end)`` of each piece, in bytes of the text as it was given.

        Byte pieces of one character share its whole span.
        """
        return [(i, self.pieces[i], begin, end) for _, ids, places, _ in self.encoded([text]) for i, (begin, end) in zip(ids.tolist(), places.tolist(), strict=True)]

    def decode(self, ids: np.ndarray, first: bool = True) -> bytes:
        """The text of the ids, in UTF-8, as the library's decode gives it; not the ``first`` ones keep the space at their start."""
        listed, at, out = ids.tolist(), 0, []
        if first and (self.dummy_prefix or self.squeeze):  # one space mark at the start is not of the text; more are not, if spaces are squeezed
            for at, i in enumerate(listed):
                if i in self.byte_value:
                    break
                marked = self.pieces[i].startswith(SPACE)
                part = self.decoded[i][1:] if marked else self.decoded[i]
                if part or marked and not self.squeeze:
                    out.append(part)
                    at += 1
                    break
            else:
                return b""
        table = self.decoded
        if not self.byte_ids[ids].any():
            return b"".join([*out, *[table[i] for i in listed[at:]]])
        pending = bytearray()
        for i in listed[at:]:
            if i in self.byte_value:
                pending.append(self.byte_value[i])
                continue
            if pending:
                out.append(_one_by_one(bytes(pending)))
                pending.clear()
            out.append(table[i])
        return b"".join(out) + _one_by_one(bytes(pending))


def _cut(text: bytes, at: int) -> int:
    """Where a part of about _PART bytes from ``at`` on ends: before a run of spaces, never inside one, or at the end."""
    if len(text) - at <= _PART or (end := text.find(b" ", at + _PART)) < 0:
        return len(text)
    stop = at + len(text[at:end].rstrip(b" "))
    if stop > at:
        return stop
    word = _NOT_SPACE(text, end)  # the part begins with all of a long run, and goes on with the word after it
    end = text.find(b" ", word.start()) if word else -1
    return end if end >= 0 else len(text)


def _with_runs(words: pa.Array, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """What stands between single spaces, as words that begin with all spaces of a run before them but one, marked.

    ``offsets`` are the places of each part's first word; a run at the end of a
    part is a word of its own.
    """
    empty = pc.binary_length(words).to_numpy(zero_copy_only=False) == 0
    if not empty.any():
        return words, offsets
    places = np.arange(len(words))
    kept = ~empty
    last = offsets[1:] - 1
    kept[last] = True
    full = np.concatenate([[-1], np.maximum.accumulate(np.where(empty, -1, places))[:-1]])
    before = places - np.maximum(full + 1, np.repeat(offsets[:-1], np.diff(offsets)))
    some = np.flatnonzero(kept)
    chosen, runs = words.take(pa.array(some)), before[some]
    long = runs > 0
    if long.any():
        made = [SPACE * n + w for n, w in zip(runs[long].tolist(), chosen.filter(pa.array(long)).to_pylist(), strict=True)]
        chosen = pc.replace_with_mask(chosen, pa.array(long), pa.array(made, chosen.type))
    return chosen, np.concatenate([[0], np.cumsum(kept)])[offsets]


def _utf8_length(text: bytes, at: int) -> int:
    """Length of the UTF-8 character at ``at``, 0 if there is none."""
    first = text[at]
    length = 1 if first < 0x80 else 2 if 0xC2 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF5 else 0
    try:
        return length if length and len(text[at : at + length].decode()) == 1 else 0
    except UnicodeDecodeError:
        return 0


def _one_by_one(pending: bytes) -> bytes:
    """Bytes as UTF-8, with U+FFFD for each byte that begins no character."""
    try:
        pending.decode()
        return pending
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(pending):
            length = _utf8_length(pending, at)
            out.append(pending[at : at + length] if length else _BAD.encode())
            at += length or 1
        return b"".join(out)


def encode_and_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, also: Sequence[str] = ()) -> DataFrame:
    """``(id, *also, n_tokens, ids_sha256, decoded_sha256, spans_sha256)`` per row, and ``ids`` if asked for.

    ``also`` are other columns of ``df`` that go along. ``spans_sha256`` is of
    the begins and ends of all pieces but the begin and end ids in bytes of
    the text, as 64-bit pairs, low byte first. Texts are encoded whole with
    begin and end ids and decoded again. A null or empty text has those two
    ids alone and decodes to an empty text; repeated rows give repeated rows;
    a null id stays null; an empty table gives none. The model file travels to
    the executors with the function, so it need not be on their disks.
    """
    prefer_small_batches(df.sparkSession)
    with open(model_path, "rb") as file:
        serialized = file.read()
    picked = df.select(F.col(id_col).cast("long").alias("id"), *also, F.col(text_col).alias("__tm_text"))
    carried = len(picked.columns) - 1
    made = [StructField(name, kind) for name, kind in (("n_tokens", LongType()), ("ids_sha256", StringType()), ("decoded_sha256", StringType()), ("spans_sha256", StringType()), *([("ids", ArrayType(IntegerType()))] if with_ids else []))]
    schema = StructType([*picked.schema.fields[:carried], *made])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(serialized)
        begin, end = (np.array([i], "<u4") for i in (model.begin, model.end))
        for batch in batches:
            texts = [t or b"" for t in texts_as_bytes(batch.column(carried))]
            sizes, kept = [2] * len(texts), [[begin] for _ in texts] if with_ids else []
            digests = [(sha256(begin), sha256(), sha256()) for _ in texts]
            for number, ids, places, decoded in model.encoded(texts):
                sizes[number] += len(ids)
                for digest, part in zip(digests[number], (np.ascontiguousarray(ids), decoded, places), strict=True):
                    digest.update(part)
                if with_ids:
                    kept[number].append(ids)
            for digest, _, _ in digests:
                digest.update(end)
            columns = [*batch.columns[:carried], pa.array(sizes, pa.int64()), *[pa.array([d[i].hexdigest() for d in digests], pa.string()) for i in range(3)]]
            if with_ids:
                values = np.concatenate([part for parts in kept for part in (*parts, end)]).astype(np.int32) if texts else np.empty(0, np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
            yield pa.RecordBatch.from_arrays(columns, names)

    return picked.mapInArrow(run, schema)


def piece_spans(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)``: every piece with its id and the bytes of the original text it stands for."""
    prefer_small_batches(df.sparkSession)
    with open(model_path, "rb") as file:
        serialized = file.read()
    kind = pa.list_(pa.struct([("piece_id", pa.int32()), ("piece", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(serialized)
        for batch in batches:
            made = [[dict(zip(("piece_id", "piece", "begin", "end"), s, strict=True)) for s in model.spans(t or b"")] for t in texts_as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind)], ["id", "spans"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, spans array<struct<piece_id:int,piece:string,begin:long,end:long>>")
