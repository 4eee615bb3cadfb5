"""Texts as sequences of independently tokenised units, each encoded once per task.

A unit runs from one transition "other byte -> separator" to the next, so units cover a
text and start with its separators.  A tokeniser whose pre-tokeniser or vocabulary can't
join what stands on both sides of such a transition gives the same tokens for the whole
text as for its units in turn; each operator states why this holds for its tokeniser.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from palimpsest.llm.textkernel import SLAB_BYTES, span_hash, string_buffers

AT_ONCE = 2_000  # units that a library encodes in one call, whose results are held as objects
FIRST = np.uint64(0xA5A5A5A5DEADBEEF)


def ascii_set(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_WORDS = ascii_set("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_MARKS = ascii_set("".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()))
#: Second bytes, after 0xC3, of the letters from U+00C0 to U+00FF.
_LATIN = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])


class UnitSlab:
    """Units of some consecutive rows; lo[i]:lo[i + 1] are those of row first + i.

    cut_marks: a unit also starts at an ASCII punctuation mark after an ASCII letter or digit
    or a letter from U+00C0 to U+00FF.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, sep: np.ndarray, mark_first: bool, cut_marks: bool = False) -> None:
        self.first, self.n_rows, self.mark_first = first, len(offsets) - 1, mark_first
        self.data, self.offsets = data, offsets - offsets[0]
        is_sep = sep[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = is_sep[1:] & ~is_sep[:-1]
        if cut_marks:
            word = _WORDS[data[:-1]]
            word[1:] |= _LATIN[data[1:-1]] & (data[:-2] == 0xC3)
            begins[1:-1] |= _MARKS[data[1:]] & word
        begins[self.offsets] = True
        self.start = np.flatnonzero(begins[:-1])
        self.end = np.append(self.start[1:], len(data)) if len(self.start) else self.start
        self.lo = np.searchsorted(self.start, self.offsets)
        self.hash = span_hash(data, self.start, self.end)
        if mark_first and len(self.start):
            head = self.lo[:-1][np.diff(self.lo) > 0]
            self.hash[head] ^= FIRST
        self.raw = data.tobytes()

    def same(self, other: np.ndarray) -> bool:
        """Whether the bytes of every unit are those of the unit other[i]."""
        size = self.end - self.start
        if not np.array_equal(size, size[other]):
            return False
        at = np.arange(len(self.data)) + np.repeat(self.start[other] - self.start, size)  # units cover the slab
        return np.array_equal(self.data[at], self.data)

    def row(self, r: int) -> bytes:
        return self.raw[self.offsets[r] : self.offsets[r + 1]]


def unit_slabs(column: pa.Array, sep: np.ndarray, mark_first: bool = False, cut_marks: bool = False) -> Iterator[UnitSlab]:
    if not len(column):
        return
    data, offsets = string_buffers(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLAB_BYTES, side="right")) - 1)
        last = min(last, len(column))
        yield UnitSlab(data[offsets[first] : offsets[last]], offsets[first : last + 1], first, sep, mark_first, cut_marks)
        first = last


def _distinct(slab: UnitSlab) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct unit, which of them each unit is), by their bytes."""
    _, first, which = np.unique(slab.hash, return_index=True, return_inverse=True)
    if not slab.same(first[which]):  # a collision: group by bytes
        heads = np.isin(np.arange(len(slab.start)), slab.lo[:-1]).tolist()
        groups: dict = {}
        of = [groups.setdefault((h and slab.mark_first, slab.raw[s:e]), len(groups)) for h, s, e in zip(heads, slab.start.tolist(), slab.end.tolist(), strict=True)]
        first, which = np.unique(of, return_index=True)[1], np.array(of)
    return first, which


class UnitCache:
    """What `encode` gave for the units seen lately, by their bytes.

    Two generations of at most `limit` units and one slab's more: a unit that is met again
    moves to the younger one, and when that is full the older one is dropped.  Hashes only
    group the units of a slab, and their groups are compared by bytes.
    """

    def __init__(self, encode: Callable[[list[bytes], list[bool]], list], limit: int = 150_000) -> None:
        self.encode, self.limit = encode, limit
        self.young: dict = {}
        self.old: dict = {}

    def of(self, slab: UnitSlab) -> tuple[list, np.ndarray]:
        """(payloads of the distinct units, which of them each unit has)."""
        first, which = _distinct(slab)
        units = [slab.raw[s:e] for s, e in zip(slab.start[first].tolist(), slab.end[first].tolist(), strict=True)]
        heads = np.isin(first, slab.lo[:-1]).tolist() if slab.mark_first else [False] * len(first)
        keys = [(u,) if h else u for u, h in zip(units, heads, strict=True)] if slab.mark_first else units
        young, old = self.young, self.old
        payload = [young.get(k) for k in keys]
        new = []
        for i, x in enumerate(payload):
            if x is None:
                k = keys[i]
                if (y := old.get(k)) is None:
                    new.append(i)
                else:
                    payload[i] = young[k] = y
        if new:
            for i, x in zip(new, self.encode([units[i] for i in new], [heads[i] for i in new]), strict=True):
                payload[i] = young[keys[i]] = x
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return payload, which


def spans(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers at[i] .. at[i] + size[i] - 1 of every i in turn."""
    return np.arange(int(size.sum())) + np.repeat(at - (np.cumsum(size) - size), size)


class _Packed:
    """Units in order of their hashes, of which each is there once: bytes and payloads in arrays."""

    def __init__(self, kind: np.dtype) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.key_at, self.key_size, self.at, self.size = (np.zeros(0, np.uint32) for _ in range(4))
        self.keys, self.values = np.zeros(0, np.uint8), np.zeros(0, kind)

    def __len__(self) -> int:
        return len(self.hash)

    def find(self, slab: UnitSlab, units: np.ndarray) -> np.ndarray:
        """Where each of these units of the slab stands, -1 if nowhere; hashes are confirmed by bytes."""
        if not len(self) or not len(units):
            return np.full(len(units), -1)
        place = np.minimum(np.searchsorted(self.hash, slab.hash[units]), len(self) - 1)
        size = slab.end[units] - slab.start[units]
        place[(self.hash[place] != slab.hash[units]) | (self.key_size[place] != size)] = -1
        hit = np.flatnonzero(place >= 0)
        other = slab.data[spans(slab.start[units[hit]], size[hit])] != self.keys[spans(self.key_at[place[hit]].astype(np.int64), size[hit])]
        if other.any():
            place[np.repeat(hit, size[hit])[other]] = -1
        return place

    def add(self, slab: UnitSlab, units: np.ndarray, values: np.ndarray, size: np.ndarray) -> None:
        """values: the payloads of the units in turn; a unit whose hash another has is left out."""
        hashes, first = np.unique(slab.hash[units], return_index=True)
        place = np.searchsorted(self.hash, hashes)
        new = self.hash[np.minimum(place, len(self) - 1)] != hashes if len(self) else np.ones(len(hashes), bool)
        first, place, hashes = first[new], place[new], hashes[new]
        start, length, count = slab.start[units[first]], (slab.end - slab.start)[units[first]], size[first]
        self.hash = np.insert(self.hash, place, hashes)
        for name, x in (("key_at", len(self.keys) + np.cumsum(length) - length), ("key_size", length), ("at", len(self.values) + np.cumsum(count) - count), ("size", count)):
            setattr(self, name, np.insert(getattr(self, name), place, x.astype(np.uint32)))
        self.keys = np.concatenate([self.keys, slab.data[spans(start, length)]])
        self.values = np.concatenate([self.values, values[spans((np.cumsum(size) - size)[first], count)]])


class PackedUnits:
    """A UnitCache whose payloads are numbers, kept in arrays: a slab's units are looked up
    together, and a unit takes its bytes, its numbers and 24 bytes.

    `encode` gives the payloads of some units in turn and the length of each.  Two
    generations as there; one also ends at `BYTES` of unit bytes or payloads.
    """

    BYTES = 1 << 26

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kind: np.dtype, limit: int = 600_000) -> None:
        self.encode, self.kind, self.limit = encode, np.dtype(kind), limit
        self.young, self.old = _Packed(self.kind), _Packed(self.kind)

    def of(self, slab: UnitSlab) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, at, size, which): numbers[at[i] : at[i] + size[i]] is the payload of the
        distinct unit i, which[j] the distinct unit that unit j is."""
        first, which = _distinct(slab)
        size = np.zeros(len(first), np.int64)
        found = []  # (distinct units, their payloads in turn)
        rest = np.arange(len(first))
        for table in (self.young, self.old):
            place = table.find(slab, first[rest])
            hit = place >= 0
            size[rest[hit]] = n = table.size[place[hit]].astype(np.int64)
            found.append((rest[hit], table.values[spans(table.at[place[hit]].astype(np.int64), n)]))
            rest = rest[~hit]
        if len(rest):
            values, n = self.encode([slab.raw[s:e].decode() for s, e in zip(slab.start[first[rest]].tolist(), slab.end[first[rest]].tolist(), strict=True)])
            size[rest] = n
            found.append((rest, values))
        at = np.cumsum(size) - size
        numbers = np.zeros(int(size.sum()), self.kind)
        for units, values in found:
            numbers[spans(at[units], size[units])] = values
        for units, values in found[1:]:
            self.young.add(slab, first[units], values, size[units])
        if len(self.young) > self.limit or max(len(self.young.keys), self.young.values.nbytes) > self.BYTES:
            self.old, self.young = self.young, _Packed(self.kind)
        return numbers, at, size, which
