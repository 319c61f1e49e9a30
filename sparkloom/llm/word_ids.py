"""Token ids of whole texts from those of their parts, each part of a worker worked out once.

A text is cut only where the byte-level pre-tokenizer's pattern always begins a new piece, and where its one look ahead, at the
end of white space, finds the same in the part alone (:data:`_CUTS`). So a part is mostly a word behind its space, or the marks and line ends
behind one, and the ids of a text are those of its parts. Marks do not make new words: what they stand at is a part of its own. Places to cut are found
for all bytes of a batch at once, and short parts are looked up together in a table that is rows of arrays (:class:`_Table`); no
part is an object of its own unless it is new. Parts used neither in this generation nor the one before are forgotten when one has touched as many as
it may. So frequent words stay, from task to task, and the table is bounded.

Special tokens are taken out of a text before it meets the pattern. So a word with one in it is not cut, nor the white space before it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"

# Kinds of bytes: space, those of letters (ASCII and LATIN), other printable ASCII, apostrophe, line feed, other ASCII, all others; and
# no byte, behind a text's last.
_SPACE, _LETTER, _PRINT, _QUOTE, _LINE, _CONTROL, _OTHER, _END = range(8)


def _kind(byte: int) -> int:
    if byte >= 0x80:
        return _OTHER  # see _kinds
    if chr(byte).isalpha():
        return _LETTER
    return {0x20: _SPACE, 0x27: _QUOTE, 0x0A: _LINE}.get(byte, _PRINT if 0x20 < byte < 0x7F else _CONTROL)


def _is_cut(before: int, here: int, after: int) -> bool:
    """May a text be cut between a byte of the kind ``before`` and one of the kind ``here``, with ``after`` behind it?

    Only letters of a piece stand behind its letters. Letters begin a piece, but for a space or an apostrophe at its start. A space behind a
    visible character begins one, and so does a space before one: what white space comes before it is a piece. Likewise a line
    feed before a letter is a piece, and all white space before it another.
    """
    visible = (_LETTER, _PRINT, _QUOTE)
    if here == _SPACE:
        return before in (*visible, _OTHER) or after in visible  # but for other white space, see _cuts
    if here == _LETTER:
        return before in (_PRINT, _LINE)
    if here == _LINE and after == _LETTER and before not in visible:
        return True
    return before == _LETTER and here in (_PRINT, _QUOTE, _LINE, _CONTROL)


_KINDS = np.array([_kind(b) for b in range(256)], np.uint8)
_CUTS = np.array([_is_cut(k >> 6, k >> 3 & 7, k & 7) for k in range(512)])

_KEY = 3  # 64-bit numbers that hold a part's bytes and, in the last byte, its length
_WIDTH = 8 * _KEY - 1
# the bytes that each number holds of a part, by the part's length
_HELD = np.array([[(1 << 8 * min(max(n - 8 * k, 0), 8)) - 1 for n in range(_WIDTH + 1)] for k in range(_KEY)], np.uint64)
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9], np.uint64)


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8, which ends in a spare byte."""
    kinds = _KINDS[data]
    leads = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    if len(leads):
        lead, next_ = data[leads], data[leads + 1]
        sign = (lead == 0xC3) & ((next_ == 0x97) | (next_ == 0xB7))
        leads = leads[~sign & ((lead < 0xC9) | (next_ <= 0x8F))]
        kinds[leads] = kinds[leads + 1] = _LETTER
    return kinds


def _ends_white(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Is the character before these places white space beyond ASCII?"""
    a, b, c = data[ends - 3], data[ends - 2], data[ends - 1]
    general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    others = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return general | others | ((b == 0xC2) & ((c == 0x85) | (c == 0xA0)))


def _cuts(data: bytes, borders: np.ndarray, special: list[bytes]) -> np.ndarray:
    """The first places of the parts of texts, which stand between ``borders``, followed by spare bytes."""
    size = int(borders[-1])
    raw = np.frombuffer(data, np.uint8)
    kinds = _kinds(raw[: size + 1]).astype(np.uint16)
    kinds[size] = _END
    cut = np.zeros(size + 1, bool)
    cut[1:size] = _CUTS[kinds[:-2] << 6 | kinds[1:-1] << 3 | kinds[2:]]
    lasts = borders[1:][np.diff(borders) > 1] - 1
    cut[lasts] = _CUTS[kinds[lasts - 1] << 6 | kinds[lasts] << 3 | _END]
    spaces = np.flatnonzero((kinds[:-1] == _OTHER) & (kinds[1:] == _SPACE)) + 1
    spaces = spaces[_ends_white(raw, spaces)]
    after = np.where(np.isin(spaces, lasts), _END, kinds[spaces + 1])
    cut[spaces] = (after >= _LETTER) & (after <= _QUOTE)
    for token in special:
        at = data.find(token, 0, size)
        while at >= 0:
            first, last = data.rfind(b" ", 0, at) + 1, data.find(b" ", at + len(token), size)
            while first and not 0x20 < data[first - 1] < 0x7F:
                first -= 1
            last = last if last >= 0 else size
            cut[first + 1 : last] = False
            at = data.find(token, last, size)
    cut[borders] = True
    return np.flatnonzero(cut[:size])


def _keys(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The keys of the parts at these places, equal only for equal parts. ``data`` ends in spare bytes, a key's length; no part is over ``_WIDTH``."""
    numbers = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    keys = np.empty((len(starts), _KEY), np.uint64)
    for k in range(_KEY):
        np.bitwise_and(numbers[starts + 8 * k], _HELD[k][lengths], out=keys[:, k])
    keys[:, -1] |= lengths.astype(np.uint64) << np.uint64(56)
    return keys


class _Table:
    """Ids by key: open addressing to numbers of entries, which stand in the order they came; their ids lie in one pool."""

    def __init__(self) -> None:
        self.n = self.held = self.now = 0
        self.keys, self.slots = np.zeros((1024, _KEY), np.uint64), np.full(4096, -1, np.int32)
        self.starts, self.counts, self.used = (np.zeros(1024, kind) for kind in (np.int64, np.int32, np.int32))
        self.pool = np.zeros(4096, np.uint32)

    def _homes(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * _SPREAD[0]
        for k in range(1, _KEY):
            mixed = ((mixed >> np.uint64(32)) ^ mixed ^ keys[:, k]) * _SPREAD[k]
        mixed ^= mixed >> np.uint64(29)
        return (mixed * _SPREAD[0] >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 if there is none."""
        slots = self._homes(keys)
        found = self.slots[slots]
        rows = np.flatnonzero((found >= 0) & self._differ(found, keys))
        while len(rows):
            slots[rows] = (slots[rows] + 1) & (len(self.slots) - 1)
            found[rows] = own = self.slots[slots[rows]]
            rows = rows[(own >= 0) & self._differ(own, keys[rows])]
        return found

    def _differ(self, entries: np.ndarray, keys: np.ndarray) -> np.ndarray:
        held = self.keys[entries]
        differ = held[:, 0] != keys[:, 0]
        for k in range(1, _KEY):
            differ |= held[:, k] != keys[:, k]
        return differ

    def _place(self, first: int) -> None:
        """Entries from this one on take the first free slots from their own on."""
        entries = np.arange(first, self.n, dtype=np.int32)
        slots = self._homes(self.keys[first : self.n])
        while len(entries):
            free = np.flatnonzero(self.slots[slots] < 0)
            taken = free[np.unique(slots[free], return_index=True)[1]]
            self.slots[slots[taken]] = entries[taken]
            rest = np.ones(len(entries), bool)
            rest[taken] = False
            entries, slots = entries[rest], (slots[rest] + 1) & (len(self.slots) - 1)

    def room(self, ids: int) -> None:
        """Room in the pool behind what is held."""
        if self.held + ids > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(max(ids, len(self.pool) // 2), np.uint32))

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """Keys that are not there yet, and different."""
        first, self.n = self.n, self.n + len(keys)
        if self.n > len(self.keys):
            more = max(len(keys), len(self.keys) // 2)
            self.keys = np.append(self.keys, np.zeros((more, _KEY), np.uint64), axis=0)
            self.starts, self.counts, self.used = (np.append(x, np.zeros(more, x.dtype)) for x in (self.starts, self.counts, self.used))
        own, counts = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.room(len(own))
        self.pool[self.held : self.held + len(own)] = own
        rows = slice(first, self.n)
        self.keys[rows], self.counts[rows], self.used[rows] = keys, counts, self.now
        self.starts[rows] = self.held + np.cumsum(counts) - counts
        self.held += len(own)
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << (2 * self.n).bit_length(), -1, np.int32)
            first = 0
        self._place(first)

    def ids(self, entries: np.ndarray) -> list[bytes]:
        starts, counts = self.starts[entries], self.counts[entries].astype(np.int64)
        ends = np.cumsum(counts)
        data = self.pool[np.repeat(starts - (ends - counts), counts) + np.arange(counts.sum())].tobytes()
        ends = (ends * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def age(self, half: int) -> None:
        """Begin a new generation if this one has touched more than ``half`` entries; those not touched since the last one began go."""
        if self.n <= half or np.count_nonzero(self.used[: self.n] == self.now) <= half:
            return
        kept = np.flatnonzero(self.used[: self.n] == self.now)
        keys, ids = self.keys[kept], self.ids(kept)
        self.__init__()
        self.add(keys, ids)
        self.now = 1


class WordIds:
    """``spaced`` gives the ids of words without spaces, each after one; ``whole`` those of texts. Ids are bytes."""

    def __init__(
        self, spaced: Callable[[list[str]], list[bytes]], whole: Callable[[list[str]], list[bytes]], special: list[str], half: int
    ) -> None:
        self.spaced, self.whole, self.half = spaced, whole, half
        self.special = [x.encode("utf-8", "surrogatepass") for x in special if x]
        self.known = _Table()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        known = self.known
        known.age(self.half)
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"".join([*parts, bytes(8 * _KEY)])
        borders = np.append(0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))))
        starts = _cuts(data, borders, self.special)
        ends = np.append(starts, borders[-1])[1:]
        lengths = ends - starts
        short = lengths <= _WIDTH
        at = np.flatnonzero(short)
        keys = _keys(data, starts[at], lengths[at])
        entries = known.find(keys)
        known.used[entries[entries >= 0]] = known.now
        new = np.flatnonzero(entries < 0)
        parts = [data[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())]
        rows = dict(zip(parts, new.tolist()))  # one of each part
        known.add(keys[np.fromiter(rows.values(), np.int64, len(rows))], self._ids(list(rows)))
        entries[new] = known.find(keys[new])
        # where the ids of each part lie in the pool, and how many they are
        places, counts = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        places[at], counts[at] = known.starts[entries], known.counts[entries]
        long = np.flatnonzero(~short)
        places[long], counts[long] = self._lend([data[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist())])
        ends = np.append(0, np.cumsum(counts))
        ids = known.pool[np.repeat(places - ends[:-1], counts) + np.arange(ends[-1])].tobytes()
        ends = (ends[np.searchsorted(starts, borders)] * 4).tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        texts = [p.decode("utf-8", "surrogatepass") for p in parts]
        words = [k for k, t in enumerate(texts) if t[0] == " " and t[1:].isalpha()]
        found = [b""] * len(texts)
        for k, ids in zip(words, self.spaced([texts[k][1:] for k in words])):
            found[k] = ids
        others = sorted(set(range(len(texts))).difference(words))
        for k, ids in zip(others, self.whole([texts[k] for k in others])):
            found[k] = ids
        return found

    def _lend(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the pool, for this batch only, and numbers of the ids of long parts."""
        found = self.whole([p.decode("utf-8", "surrogatepass") for p in parts])
        ids, counts = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        known = self.known
        known.room(len(ids))
        known.pool[known.held : known.held + len(ids)] = ids
        return known.held + np.cumsum(counts) - counts, counts
