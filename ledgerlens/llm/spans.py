"""Word spans of UTF-8 texts by a table-driven byte transducer, and an exact hash table of spans.

A ``Transducer`` has a table of classes (one per byte value), a table of next states and a table of what a
byte emits in a state.  The state after a byte must follow from that byte's class alone (checked when it is
made), so a text is read by table look-ups over whole arrays; a text longer than a segment carries its state
and an unfinished word into the next segment.

``SpanTable`` gives equal spans of a group equal numbers.  It probes slots from a 64-bit hash, and a slot's
span counts as equal only after its bytes have been compared, so its numbers do not depend on the hash.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .tokens import mix

SEGMENT = 1 << 21
#: longer spans are hashed and compared one at a time
LONG = 512
PAD = 8
OUT, WORD = 0, 1
START, END, POINT, CAPITAL, SYMBOL = 1, 2, 4, 8, 16
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SIZE = np.uint64(0x9E3779B97F4A7C15)
_GROUP = np.uint64(0xD6E8FEB86659FD93)


class Transducer:
    """``classes``: class of every byte value; ``nexts[state, class]``; ``emits[state, class]``: set of bits."""

    def __init__(self, classes: np.ndarray, nexts: np.ndarray, emits: np.ndarray):
        if (nexts != nexts[0]).any():
            raise ValueError("the next state must follow from the byte's class alone")
        self.classes, self.nexts, self.emits, self.width = classes, nexts[0], emits.ravel(), nexts.shape[1]


def words_of(inside: np.ndarray, capitals: np.ndarray, symbols: np.ndarray) -> Transducer:
    """Words are runs of bytes that are ``inside``; also emits code points, ``capitals`` and ``symbols``."""
    byte = np.arange(256)
    follows = (byte & 0xC0) == 0x80
    kinds, classes = np.unique(np.stack([inside, follows, capitals, symbols]), axis=1, return_inverse=True)
    nexts = np.tile(np.where(kinds[0], WORD, OUT), (2, 1)).astype(np.uint8)
    emits = np.zeros(nexts.shape, np.uint8)
    for state in (OUT, WORD):
        emits[state] |= np.where(kinds[0] & (state == OUT), START, 0).astype(np.uint8)
        emits[state] |= np.where(~kinds[0] & (state == WORD), END, 0).astype(np.uint8)
        emits[state] |= np.where(~kinds[1], POINT, 0).astype(np.uint8)
        emits[state] |= np.where(kinds[2], CAPITAL, 0).astype(np.uint8)
        emits[state] |= np.where(kinds[3], SYMBOL, 0).astype(np.uint8)
    return Transducer(classes.ravel().astype(np.uint8), nexts, emits)


class Run:
    """One pass of a transducer over the rows of ``raw``: ``words()`` yields the spans, ``count(bit)`` the totals."""

    def __init__(self, machine: Transducer, raw: np.ndarray, offsets: np.ndarray, bits: tuple = (), segment: int = SEGMENT):
        self.machine, self.raw, self.offsets, self.segment = machine, raw, offsets, segment
        self.totals = {b: np.zeros(len(offsets) - 1, np.int64) for b in bits}

    def words(self):
        """(row, first byte, end) of the words, in order; the totals are complete when this has ended."""
        m, offsets, n = self.machine, self.offsets, int(self.offsets[-1])
        state, pending = OUT, -1
        for lo in range(0, n, self.segment):
            hi = min(lo + self.segment, n)
            classes = m.classes[self.raw[lo:hi]]
            after = m.nexts[classes]
            before = np.empty_like(after)
            before[0], before[1:] = state, after[:-1]
            firsts = offsets[:-1]
            before[firsts[(firsts >= lo) & (firsts < hi)] - lo] = OUT
            out = m.emits[before * np.uint8(m.width) + classes]
            inside = np.clip(offsets, lo, hi) - lo
            for bit, total in self.totals.items():
                at = np.flatnonzero(out & bit)
                total += np.diff(np.searchsorted(at, inside))
            mark = np.zeros(hi - lo + 1, bool)
            mark[:-1] = (out & END) != 0
            closed = offsets[1:]
            closed = closed[(closed > lo) & (closed <= hi)] - lo
            mark[closed] |= after[closed - 1] == WORD
            starts, ends = np.flatnonzero(out & START) + lo, np.flatnonzero(mark) + lo
            if pending >= 0:
                starts = np.concatenate([[pending], starts])
            pending = -1
            if len(starts) > len(ends):
                pending, starts = int(starts[-1]), starts[:-1]
            state = after[-1]
            yield np.searchsorted(offsets, starts, "right") - 1, starts, ends

    def count(self, bit: int) -> np.ndarray:
        return self.totals[bit]


def padded(raw: np.ndarray) -> np.ndarray:
    """A copy that eight bytes can be loaded from at every place."""
    return np.concatenate([raw, np.zeros(PAD, np.uint8)])


def _eights(raw: np.ndarray) -> np.ndarray:
    """Eight bytes from every place of a padded array, as numbers (a view)."""
    return np.ndarray((max(len(raw) - PAD + 1, 0),), "<u8", raw, strides=(1,))


def span_hashes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of a padded array; they depend on the spans' bytes alone."""
    eights = _eights(raw)
    h = sizes.astype(np.uint64) * _SIZE
    at = np.flatnonzero(sizes <= LONG)
    done = 0
    while len(at):
        load = eights[starts[at] + done] & _KEEP[np.minimum(sizes[at] - done, 8)]
        h[at] = mix(h[at] ^ load)
        done += 8
        at = at[sizes[at] > done]
    for i in np.flatnonzero(sizes > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : starts[i] + sizes[i]].tobytes())
    return h


def same_spans(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the bytes of every span equal as many bytes of ``other`` from ``places`` (both padded)."""
    one, two = _eights(raw), _eights(other)
    same = np.ones(len(starts), bool)
    at = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    done = 0
    while len(at):
        keep = _KEEP[np.minimum(sizes[at] - done, 8)]
        equal = (one[starts[at] + done] & keep) == (two[places[at] + done] & keep)
        same[at[~equal]] = False
        done += 8
        at = at[equal & (sizes[at] > done)]
    for i in np.flatnonzero(sizes > LONG).tolist():
        same[i] = np.array_equal(raw[starts[i] : starts[i] + sizes[i]], other[places[i] : places[i] + sizes[i]])
    return same


class SpanTable:
    """Numbers 0, 1, 2, ... of the distinct (group, span) of one padded array, by open addressing."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.n = raw, 0
        self.slots = np.full(1024, -1, np.int64)
        self.groups, self.starts, self.sizes = (np.zeros(0, np.int64) for _ in range(3))
        self.keys = np.zeros(0, np.uint64)

    def _room(self, more: int) -> None:
        if 2 * (self.n + more) > len(self.slots):
            self.slots = np.full(1 << int(2 * (self.n + more)).bit_length(), -1, np.int64)
            todo = np.arange(self.n)
            at = self._first(self.keys[: self.n])
            while len(todo):  # the held spans differ, so a free slot is all they need
                free = todo[self.slots[at[todo]] < 0]
                self.slots[at[free]] = free
                todo = todo[self.slots[at[todo]] != todo]
                at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
        if self.n + more > len(self.starts):
            room = max(self.n + more, 2 * self.n) - len(self.starts)
            for name in ("groups", "starts", "sizes", "keys"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros(room, old.dtype)]))

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def insert(self, groups: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
        """The number of every span, new or held."""
        hashes = span_hashes(self.raw, starts, sizes) if hashes is None else hashes
        keys = mix(hashes ^ (groups.astype(np.uint64) * _GROUP))
        self._room(len(keys))
        out = np.empty(len(keys), np.int64)
        todo, at = np.arange(len(keys)), self._first(keys)
        while len(todo):
            place = at[todo]
            free = np.flatnonzero(self.slots[place] < 0)
            if len(free):  # all that meet a free slot write, the last one to do so has it
                claim = place[free]
                self.slots[claim] = free
                won = free[self.slots[claim] == free]
                new = np.arange(self.n, self.n + len(won))
                who = todo[won]
                self.slots[place[won]] = new
                self.groups[new], self.starts[new], self.sizes[new], self.keys[new] = groups[who], starts[who], sizes[who], keys[who]
                self.n += len(won)
            held = self.slots[place]
            same = (self.keys[held] == keys[todo]) & (self.groups[held] == groups[todo]) & (self.sizes[held] == sizes[todo])
            check = np.flatnonzero(same)
            same[check] = same_spans(self.raw, starts[todo[check]], sizes[todo[check]], self.raw, self.starts[held[check]])
            out[todo[same]] = held[same]
            todo = todo[~same]
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
        return out
