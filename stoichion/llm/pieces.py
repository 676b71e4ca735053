"""Cuts of texts that no byte-level tokenizer of the usual pattern crosses, and a table of their token ids.

The pattern lets a blank only begin a pre-token, and only right before a character that isn't white space. So between a
character that isn't white space and a single blank that is followed by another such character there always is a
boundary; so is there between a letter and a closing mark. Each part can be encoded by itself, and as words recur, most
parts of a text are found in the table. Cuts, hashes and look-ups of a group of texts are numpy passes over its bytes;
only parts not met before become Python strings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from stoichion.llm.textbytes import _BYTE_CODE, _POWERS, buffers, mix

#: Slots of the table, and bytes of parts and of ids that it keeps; when half of them are taken or the bytes are, it starts anew.
SLOTS, KEPT_BYTES = 1 << 20, 1 << 25

#: Bytes that may begin, and that may come last but one in, white space beyond ASCII; no cut is made next to them.
_MAY_BEGIN = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3]) | (np.arange(256) < 0x21)
_MAY_END = np.isin(np.arange(256), [0xC2, 0x80, 0x81, 0x9A])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_MARK = np.isin(np.arange(256), list(b".,;:!?#$%&*|"))

_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What make() gives, kept in the worker process for its later tasks where the package can be imported there."""
    try:
        from stoichion.llm import pieces as home
    except ImportError:
        return make()
    if key not in home._HELD:
        home._HELD[key] = make()
    return home._HELD[key]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the parts of the texts begin, in order; each text begins a part unless it is empty."""
    n = len(data)
    begin = np.zeros(n + 1, bool)
    if n > 2:
        before, here, after = data[:-2], data[1:-1], data[2:]
        last_but_one = np.empty(n - 2, np.uint8)
        last_but_one[0], last_but_one[1:] = 0, data[: n - 3]
        dark = (before > 0x20) & ~((before >= 0x80) & _MAY_END[last_but_one])
        begin[1 : n - 1] = ((here == 0x20) & dark & ~_MAY_BEGIN[after]) | (_LETTER[before] & _MARK[here])
        # Texts stand next to each other here: what looks over the end of one isn't a cut.
        edge = offsets[(offsets > 0) & (offsets < n)]
        begin[edge - 1] &= _MARK[data[edge - 1]]
    begin[offsets[:-1]] = True
    begin[n] = False
    return np.flatnonzero(begin)


class PieceCache:
    """encode(parts) gives for each part its ids as little-endian unsigned 32-bit integers.

    A part is looked up by a 64-bit hash of its bytes, its length and its first and last byte; its bytes are then
    compared with those kept, and parts that merely look alike are encoded by themselves.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], slots: int = SLOTS, uncut: Callable[[pa.Array], np.ndarray] | None = None) -> None:
        """uncut says which texts must be encoded in one part."""
        self.encode, self.slots, self.uncut = encode, slots, uncut
        self.clear()

    def clear(self) -> None:
        self.keys, self.tags = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint32)
        self.start, self.count = np.zeros(self.slots, np.int64), np.zeros(self.slots, np.int32)
        self.store, self.used, self.taken = np.zeros(1 << 16, np.uint32), 0, 0
        self.origin, self.size, self.kept, self.filled = np.zeros(self.slots, np.int64), np.zeros(self.slots, np.int64), np.zeros(1 << 16, np.uint8), 0

    def slot(self, key: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """The slot of each part, or minus one less the free slot where it would go."""
        mask = self.slots - 1
        out = (key & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(key))
        while len(todo):
            at = out[todo]
            full = self.tags[at] != 0
            same = (self.keys[at] == key[todo]) & (self.tags[at] == tag[todo])
            free = todo[~full]
            out[free] = -1 - out[free]
            todo = todo[full & ~same]
            out[todo] = (out[todo] + 1) & mask
        return out

    def stored(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the parts begin in the store, and how many there are."""
        found = self.encode([x.decode() for x in parts])
        count = np.fromiter((len(x) // 4 for x in found), np.int64, len(found))
        flat = np.frombuffer(b"".join(found), "<u4")
        if self.used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(max(len(self.store), len(flat)), np.uint32)])
        self.store[self.used : self.used + len(flat)] = flat
        start = self.used + np.cumsum(count) - count
        self.used += len(flat)
        return start, count

    def learn(self, key: np.ndarray, tag: np.ndarray, parts: list[bytes]) -> None:
        start, count = self.stored(parts)
        raw = np.frombuffer(b"".join(parts), np.uint8)
        if self.filled + len(raw) > len(self.kept):
            self.kept = np.concatenate([self.kept, np.zeros(max(len(self.kept), len(raw)), np.uint8)])
        self.kept[self.filled : self.filled + len(raw)] = raw
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        origin = self.filled + np.cumsum(size) - size
        self.filled += len(raw)
        self.taken += len(key)
        todo = np.arange(len(key))
        while len(todo):  # of parts that want one slot the first gets it
            at = -1 - self.slot(key[todo], tag[todo])
            _, first = np.unique(at, return_index=True)
            own, at = todo[first], at[first]
            self.keys[at], self.tags[at], self.start[at], self.count[at], self.origin[at], self.size[at] = key[own], tag[own], start[own], count[own], origin[own], size[own]
            todo = np.delete(todo, first)

    def differing(self, slot: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the parts, which cover data without a gap, whose bytes aren't those kept in their slots."""
        size, bad = end - begin, self.size[slot] != end - begin
        for lo in range(0, len(begin), 1 << 16):
            hi = min(lo + (1 << 16), len(begin))
            at = np.arange(begin[lo], end[hi - 1])
            at += np.repeat(self.origin[slot[lo:hi]] - begin[lo:hi], size[lo:hi])
            other = np.flatnonzero(self.kept[np.minimum(at, len(self.kept) - 1)] != data[begin[lo] : end[hi - 1]])
            bad[np.searchsorted(begin, other + begin[lo], "right") - 1] = True
        return np.flatnonzero(bad)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and for each text where its ids begin, with the end of the last."""
        if self.taken > self.slots // 2 or self.filled > KEPT_BYTES or 4 * self.used > KEPT_BYTES:
            self.clear()
        data, offsets = buffers(texts)
        begin = cuts(data, offsets)
        if self.uncut is not None and (one := self.uncut(texts)).any():
            begin = begin[~one[np.searchsorted(offsets, begin, "right") - 1] | np.isin(begin, offsets)]
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        end = np.append(begin[1:], len(data))
        up, down = _POWERS.upto(len(data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_CODE[data] * up[: len(data)], dtype=np.uint64)])
        key = mix((total[end] - total[begin]) * down[begin])
        tag = (((end - begin) & 0x7FFF) << 16 | data[begin].astype(np.int64) << 8 | data[end - 1] | 1 << 31).astype(np.uint32)
        slot = self.slot(key, tag)
        new, raw = np.flatnonzero(slot < 0), data.tobytes()
        while len(new):  # again for parts of one hash whose length or end bytes differ
            _, first = np.unique(key[new], return_index=True)
            own = new[first]
            self.learn(key[own], tag[own], [raw[a:b] for a, b in zip(begin[own].tolist(), end[own].tolist(), strict=True)])
            slot[new] = self.slot(key[new], tag[new])
            new = new[slot[new] < 0]
        start, count = self.start[slot], self.count[slot].astype(np.int64)
        for i in self.differing(slot, data, begin, end).tolist():
            (start[i],), (count[i],) = self.stored([raw[begin[i] : end[i]]])
        ends = np.cumsum(count)
        at = np.repeat(start - ends + count, count) + np.arange(ends[-1])
        bounds = np.searchsorted(begin, offsets)
        return self.store[at], np.concatenate([[0], ends])[bounds]


def id_lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """array<int> of what PieceCache gives."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
