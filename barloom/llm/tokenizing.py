"""Token ids of whole texts inside Arrow tasks.

The tokenizers library decides every id. Texts of Latin letters are cut, many at once, where a
pre-token must end: after a letter, and before a letter or the white space in front of it. Each
distinct segment is given to the library's pre-tokenizer and merges once and kept in a table of
bounded size; segments are compared on all their bytes. Texts with other characters, control
separators, strings of added tokens or a segment above SEGMENT bytes go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shingles import mix, pieces, utf8

U = np.uint64
#: Bytes of a segment, at most; four 64-bit lanes hold them.
SEGMENT = 32
#: Bytes of text handled at once; longer texts are taken in parts.
ROOM = 1 << 22
#: Segments that a worker's table holds, at most: about 60 bytes each.
CACHE = 500_000
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[0xC3:0xC6] = True
#: Bytes that only the library reads: separators, and the lead bytes of characters from U+0180 on.
ODD = np.zeros(256, bool)
ODD[[0, 0x1C, 0x1D, 0x1E, 0x1F]] = ODD[0xC6:] = True
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def vocabulary(name: str) -> str:
    """Path of one of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in prints else next(rest)) for b in range(256)}


def pack(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def flat(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start[i] .. start[i] + n[i] - 1, one run after the other."""
    ends = np.cumsum(n)
    return np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def lanes_of(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bytes of each segment as four 64-bit numbers; no segment holds a zero byte, so equal lanes are equal bytes."""
    padded = np.concatenate([data, np.zeros(SEGMENT, np.uint8)])
    words = np.ndarray((len(data) + SEGMENT - 7,), "<u8", padded.data, strides=(1,))
    out = np.zeros((4, len(start)), np.uint64)
    for k in range(4):
        some = slice(None) if k == 0 else np.flatnonzero(n > 8 * k)
        out[k, some] = words[start[some] + 8 * k] & MASK[np.clip(n[some] - 8 * k, 0, 8)]
    return out


def hashes_of(lanes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(mix(mix(lanes[0]) + lanes[1]) + lanes[2]) + lanes[3])


class Part:
    """Segments of some bytes of text: where they begin, how long they are, and their places in the table."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, letter: np.ndarray):
        n = len(data)
        before = np.concatenate([[False], letter[:-1]])
        last = np.concatenate([[np.uint8(0)], data[:-1]])
        inner = edges[edges < n]
        before[inner], last[inner] = False, 0
        first = letter & ~before & (last != 39)  # after an apostrophe a contraction may end inside the letters
        cut = np.zeros(n + 1, bool)
        cut[edges] = cut[0] = cut[n] = True
        cut[:n] |= (before & ~letter) | (first & ~BLANK[last])
        cut[np.flatnonzero(first & BLANK[last]) - 1] = True
        at = np.flatnonzero(cut)
        self.start, self.n = at[:-1], np.diff(at)
        self.data = data
        at = self.start
        second = np.minimum(at + 1, max(n - 1, 0))
        #: letters alone, or a space and letters: one pre-token
        self.plain = letter[at] | ((data[at] == 32) & letter[second] & (self.n > 1))


class Encoder:
    """Segments and ids of text columns by one vocabulary; known segments are sorted by hash."""

    def __init__(self, path: str):
        self.library = load(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.spaceless = self.library.normalizer is not None  # lower case, white space dropped
        self.clock = 0
        self.h, self.lanes = np.zeros(0, np.uint64), np.zeros((4, 0), np.uint64)
        self.at, self.n, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def tokens(self, piece: str) -> list[int]:
        """Ids of a pre-token, by the library's merges."""
        return [t.id for t in self.library.model.tokenize(piece)]

    def pieces(self, segment: bytes, plain: bool) -> list[str]:
        """The library's pre-tokens of a segment."""
        if plain:
            return [(segment.strip() if self.spaceless else segment).decode("latin-1").translate(byte_letters())]
        return [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(segment.decode())]

    def odd_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that only the library reads."""
        follow = np.flatnonzero((data & 0xC0) == 0x80)
        lead, c = data[follow - 1], data[follow]
        places = [np.flatnonzero(ODD[data]), follow[((lead == 0xC4) & (c == 0xB0)) | ((lead == 0xC2) & ((c == 0x85) | (c == 0xA0)))]]
        raw = data.tobytes() if self.added else b""
        for a in self.added:
            at = raw.find(x := a.encode())
            while at >= 0:
                places.append(np.array([at]))
                at = raw.find(x, at + 1)
        rows = np.zeros(len(offsets) - 1, bool)
        rows[np.searchsorted(offsets, np.concatenate(places), "right") - 1] = True
        return rows

    @staticmethod
    def letters(data: np.ndarray) -> np.ndarray:
        letter = LETTER[data]
        follow = np.flatnonzero((data & 0xC0) == 0x80)
        lead, c = data[follow - 1], data[follow]
        letter[follow] = np.where(lead == 0xC2, (c == 0xAA) | (c == 0xB5) | (c == 0xBA), (lead > 0xC2) & ~((lead == 0xC3) & ((c == 0x97) | (c == 0xB7))))
        letter[follow - 1] = letter[follow]
        return letter

    def slices(self, column: pa.Array, room: int | None = None) -> Iterator[tuple[int, int, np.ndarray, list[tuple[Part, np.ndarray]]]]:
        """(first row, stop row, which rows only the library reads, [(part, its edges by row)]) for about `room` bytes at a time."""
        room = room or ROOM
        for first, stop in pieces(column, room):
            own = column.slice(first, stop - first)
            odd = self.odd_rows(*utf8(own))
            if self.spaceless:
                own = pc.utf8_lower(own)
            data, offsets = utf8(own)
            parts = []
            if len(data) <= 2 * room:
                parts += [(Part(data, offsets, self.letters(data)), offsets)] if len(data) else []
            elif not odd[0]:  # one long text, cut where white space follows an ASCII letter
                at = 0
                while at < len(data):
                    end = min(at + room, len(data))
                    ok = np.flatnonzero(LETTER[data[at : end - 1]] & (data[at : end - 1] < 128) & (data[at + 1 : end] == 32)) if end < len(data) else ()
                    if end < len(data) and not len(ok):  # no such place: the library has to read it
                        odd[0], parts = True, []
                        break
                    end = at + int(ok[-1]) + 1 if end < len(data) else end
                    some = data[at:end]
                    parts.append((Part(some, np.array([0, len(some)]), self.letters(some)), np.array([0, len(some)])))
                    at = end
            for p, edges in parts:  # texts with segments too long
                odd[np.searchsorted(edges, p.start[p.n > SEGMENT], "right") - 1] = True
            yield first, stop, odd, parts

    @staticmethod
    def distinct(part: Part, take: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the segments `take` of a part: distinct hashes in order, the lanes and the first of each, which one every segment has, and which have it with other bytes."""
        lanes = lanes_of(part.data, part.start[take], part.n[take])
        u, where, back = np.unique(hashes_of(lanes), return_index=True, return_inverse=True)
        own = lanes[:, where]
        return u, own, take[where], back, (lanes != own[:, back]).any(axis=0)

    @staticmethod
    def raw(part: Part, which: np.ndarray) -> list[tuple[bytes, bool]]:
        """Bytes of segments, and whether each is one pre-token."""
        data = part.data.tobytes()
        return [(data[s : s + n], plain) for s, n, plain in zip(part.start[which].tolist(), part.n[which].tolist(), part.plain[which].tolist(), strict=True)]

    def _ids_of(self, part: Part, u: np.ndarray, own: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes) of the distinct segments of a part, learning new ones, and which of them the table holds with other bytes."""
        self.clock += 1
        at = np.searchsorted(self.h, u)
        there = np.zeros(len(u), bool)
        inside = at < len(self.h)
        there[inside] = self.h[at[inside]] == u[inside]
        self.used[at[there]] = self.clock
        new = np.flatnonzero(~there)
        if len(new):
            if len(self.h) and len(self.h) + len(new) > CACHE:
                self._forget()
            found: list[int] = []
            sizes: list[int] = []
            was = 0
            for x, plain in self.raw(part, where[new]):
                for p in self.pieces(x, plain):
                    found += self.tokens(p)
                sizes.append(len(found) - was)
                was = len(found)
            n = np.array(sizes, np.int64)
            places = len(self.ids) + np.cumsum(n) - n
            self.ids = np.concatenate([self.ids, np.array(found, np.uint32)])
            h = np.concatenate([self.h, u[new]])
            order = np.argsort(h, kind="stable")
            self.h = h[order]
            self.lanes = np.concatenate([self.lanes, own[:, new]], axis=1)[:, order]
            self.at, self.n = np.concatenate([self.at, places])[order], np.concatenate([self.n, n])[order]
            self.used = np.concatenate([self.used, np.full(len(new), self.clock)])[order]
            at = np.searchsorted(self.h, u)
        n = self.n[at]
        return self.ids[flat(self.at[at], n)], n, (self.lanes[:, at] != own).any(axis=0)

    def _forget(self) -> None:
        """Drops what was last used longest ago, the current part's own excepted."""
        keep = self.used >= min(self.clock, int(np.median(self.used)) + 1)
        n, at = self.n[keep], self.at[keep]
        self.ids = self.ids[flat(at, n)]
        self.h, self.lanes, self.used, self.n = self.h[keep], np.ascontiguousarray(self.lanes[:, keep]), self.used[keep], n
        self.at = np.cumsum(n) - n

    def segments(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[tuple[bytes | str, bool]]]]:
        """(first row, stop row, row of each unit, its number, distinct units): units are segments, with whether they are one pre-token, or whole texts."""
        for first, stop, odd, parts in self.slices(column):
            rows, codes, units = [], [], []
            for part, edges in parts:
                row = np.searchsorted(edges, part.start, "right") - 1
                take = np.flatnonzero(~odd[row])
                _, _, where, back, wrong = self.distinct(part, take)
                odd[row[take[wrong]]] = True
                rows.append(row[take])
                codes.append(back + len(units))
                units += self.raw(part, where)
            rows, codes = self._with_odd(odd, rows, codes, len(units))
            units += [(column[first + k].as_py(), False) for k in np.flatnonzero(odd).tolist()]
            yield first, stop, rows, codes, units

    def units(self, column: pa.Array, room: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, stop row, row of each unit, its number, ids of all distinct units, how many each has)."""
        for first, stop, odd, parts in self.slices(column, room):
            rows, codes, ids, sizes = [], [], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
            at = 0
            for part, edges in parts:
                row = np.searchsorted(edges, part.start, "right") - 1
                take = np.flatnonzero(~odd[row])
                u, own, where, back, wrong = self.distinct(part, take)
                found, n, other = self._ids_of(part, u, own, where)
                odd[row[take[wrong | other[back]]]] = True
                rows.append(row[take])
                codes.append(back + at)
                ids.append(found)
                sizes.append(n)
                at += len(n)
            rows, codes = self._with_odd(odd, rows, codes, at)
            whole = [self.whole(column[first + k].as_py()) for k in np.flatnonzero(odd).tolist()]
            yield first, stop, rows, codes, np.concatenate([*ids, *whole]), np.concatenate([*sizes, np.array([len(x) for x in whole], np.int64)])

    @staticmethod
    def _with_odd(odd: np.ndarray, rows: list[np.ndarray], codes: list[np.ndarray], at: int) -> tuple[np.ndarray, np.ndarray]:
        row, code = np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *codes])
        if not odd.any():
            return row, code
        good, alone = ~odd[row], np.flatnonzero(odd)
        row, code = np.concatenate([row[good], alone]), np.concatenate([code[good], at + np.arange(len(alone))])
        order = np.argsort(row, kind="stable")
        return row[order], code[order]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, stop row, ids, offsets) of a text column without nulls: row first + k has ids[offsets[k] : offsets[k + 1]]."""
        for first, stop, row, code, ids, sizes in self.units(column):
            n = sizes[code]
            counts = np.bincount(row, n, stop - first).astype(np.int64)
            yield first, stop, ids[flat((np.cumsum(sizes) - sizes)[code], n)], np.concatenate([[0], np.cumsum(counts)])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's own: what one task has learnt, the next one on the worker knows. Another vocabulary takes its place."""
    return Encoder(path)
