"""Similarity join on word shingles: count vectors in a packed R-tree, bounded by summed minima.

Every text is the set of its distinct shingles. The shingles are hashed into
groups, more of them for a large set, and the counts of the groups make the text a point. Points of different lengths are compared
by folding the longer one. Two texts can only be
similar enough if the sum of their coordinate-wise minima reaches the overlap that
the threshold asks for, and the same holds for the upper corners of two tree pages.

A tree over all points would compare nearly every pair of pages: counts of unrelated
texts differ only by noise, so corners overlap everywhere. The top of the index
is therefore a directory of *cells*. The hash space is divided into more blocks of
groups than a linked pair can have differing shingles, so by the pigeonhole principle
the two points agree exactly on at least one non-empty block; a cell is one block
with one content. Inside a cell the bound on the points decides which texts can be linked; a cell of any size is
compared in blocks. Texts that hang together by such bounds form a family, and each family gets its own
packed tree: points in size order, cut into pages with their corners. Pages of a family are compared when size and
corner allow it, points when the bound allows it, and the survivors are verified on their whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sparkloom.llm.common import free_name, require
from sparkloom.llm.graph import connected_components
from sparkloom.llm.words import gram_hashes, mix, signed, word_slices
from sparkloom.operators.ordering import running
from sparkloom.session import cut, remove_path, stage, stage_path

GROUPS = 128  # of a set of at most GROUPS * GROUP_LOAD shingles; larger ones have two, four, ... times as many
GROUP_LOAD = 12
PAGE_LOAD = 1 << 20
POINT_LOAD = 64
PAGE_TILE = 4  # with pages of at most 8 MB or a text, a tile holds 64 MB of sets
CELL_BLOCK = 4096
_SEEN_SETS = 200_000
_FEW_KEYS = 500_000  # repeated keys, of 24 bytes each, that are broadcast; more are joined by a shuffle
_FULL = 255  # a count this high may stand for more


@dataclass(frozen=True)
class Similarity:
    """Texts link when 100 * intersection >= percent * union of their sets of ``words``-word shingles."""

    words: int = 5
    percent: int = 80

    def overlap(self, sizes):
        """Smallest intersection of a linked pair whose set sizes add up to ``sizes``."""
        return -(-self.percent * sizes // (100 + self.percent))

    def intervals(self, largest: int) -> list[tuple[int, int, int, int]]:
        """Size intervals (low, high, blocks, spare) up to ``largest``.

        A pair inside an interval, or with its smaller side in the one before, differs in fewer
        than ``blocks - spare`` shingles. ``spare`` blocks may be empty, see ``_cells``.
        """
        found, low = [], 1
        while low <= largest:
            high = max(low, low * 3 // 2)
            while low == 1 and high < largest and self._differing(high + 1) == 0:
                high += 1
            differing = self._differing(high)
            least = max(1, low * self.percent // 100)
            blocks, spare = differing + 1, 0
            for _ in range(20):
                empty = blocks * math.exp(-least / blocks)
                spare = math.ceil(empty + 5 * math.sqrt(empty) + 2)
                blocks = differing + 1 + spare
            found.append((low, high, blocks, spare))
            low = high + 1
        return found

    def _differing(self, high: int) -> int:
        return max(s - 2 * self.overlap(s) for s in range(max(2, 2 * high - 7), 2 * high + 1))


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, sorted distinct shingles, set sizes) for runs of rows.

    A text with fewer words than a shingle has one shingle, its whole sequence; one without words has none.
    """
    for first, last, hashes, counts in word_slices(column, lower=True):
        grams = gram_hashes(hashes, words)
        ends = np.cumsum(counts)
        starts = ends - counts
        sets, sizes = [], np.zeros(last - first, np.int64)
        for row in np.flatnonzero(counts):
            n = int(counts[row])
            if n < words:
                own = gram_hashes(hashes[starts[row] : ends[row]], n, tag=n)
            else:
                own = np.sort(grams[starts[row] : ends[row] - words + 1])
                own = own[np.append(True, own[1:] != own[:-1])]
            sets.append(own)
            sizes[row] = len(own)
        yield first, last, np.concatenate(sets) if sets else np.empty(0, np.uint64), sizes


def _set_hashes(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash per set, whatever the order of its members; 0 for an empty set."""
    sums = np.append(np.uint64(0), np.cumsum(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
    ends = np.cumsum(sizes)
    return mix(sums[ends] - sums[ends - sizes])


def _cells(shingles: np.ndarray, sizes: np.ndarray, rule: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each set: (place of the set, cell hash).

    A set with no more than ``spare`` empty blocks leaves these out: among more than ``spare`` blocks on
    which it agrees with a linked set, one is not empty.
    """
    if not len(shingles):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    intervals = np.array(rule.intervals(int(sizes.max() * 100 // rule.percent) + 1), np.int64)
    home = np.searchsorted(intervals[:, 0], sizes, side="right") - 1
    starts = np.cumsum(sizes) - sizes
    places, cells = [], []
    for step in (0, 1):
        level = home + step
        level_low = intervals[np.minimum(level, len(intervals) - 1), 0]
        if step == 0:
            used = (sizes > 0) & (intervals[home, 2] - intervals[home, 3] > 1)
        else:
            used = (sizes > 0) & (level < len(intervals)) & (sizes * 100 >= rule.percent * level_low)
        chosen = np.flatnonzero(used)
        if not len(chosen):
            continue
        blocks, spare = intervals[level[chosen], 2], intervals[level[chosen], 3]
        seed = mix(level[chosen].astype(np.uint64) + np.uint64(0xA0761D6478BD642F))
        lengths = sizes[chosen]
        members = np.repeat(starts[chosen] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        own = shingles[members]
        block = (mix(own ^ np.repeat(seed, lengths)) % np.repeat(blocks, lengths).astype(np.uint64)).astype(np.int64)
        base = np.cumsum(blocks) - blocks
        slot = np.repeat(base, lengths) + block
        total = int(blocks.sum())
        content = np.zeros(total, np.uint64)
        np.add.at(content, slot, mix(own + np.uint64(0xE7037ED1A0B428DB)))
        held = np.bincount(slot, minlength=total)
        owner = np.repeat(np.arange(len(chosen)), blocks)
        empty = np.bincount(owner[held == 0], minlength=len(chosen))
        keep = (held > 0) | (empty > spare)[owner]
        number = (np.arange(total) - base[owner]).astype(np.uint64)
        # forty bits do: a chance meeting costs a comparison
        cell = mix(mix(content + held.astype(np.uint64)) ^ (seed[owner] + number)) >> np.uint64(24)
        places.append(chosen[owner[keep]])
        cells.append(cell[keep])
    return (np.concatenate(places), np.concatenate(cells)) if places else (np.empty(0, np.int64), np.empty(0, np.uint64))


def _groups(sizes: np.ndarray) -> np.ndarray:
    """Number of groups of sets: with more shingles than ``GROUP_LOAD`` in a group, counts of unrelated sets would differ too little."""
    limits = GROUPS * GROUP_LOAD << np.arange(5)  # 4096 groups at most, so that rows of a cell stay small
    return GROUPS << np.searchsorted(limits, sizes)


def _counts(shingles: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The point of each set: counts of its groups, ``_FULL`` at most."""
    groups = _groups(sizes)
    ends = np.cumsum(groups)
    slot = np.repeat(ends - groups, sizes) + (mix(shingles) & np.repeat(groups - 1, sizes).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(slot, minlength=int(groups.sum())), _FULL).astype(np.uint8).tobytes()
    return [counts[a:b] for a, b in zip((ends - groups).tolist(), ends.tolist())]


def _folded(point: bytes | np.ndarray, groups: int) -> np.ndarray:
    """A point with fewer groups."""
    counts = np.frombuffer(point, np.uint8)
    return counts if len(counts) == groups else np.minimum(counts.reshape(-1, groups).sum(axis=0, dtype=np.int64), _FULL).astype(np.uint8)


def _bounds(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap with each of some points: summed coordinate minima."""
    least = np.minimum(points, point)
    bound = least.sum(axis=1, dtype=np.int64)
    bound[(least == _FULL).any(axis=1)] = 1 << 60
    return bound


def _points_of(rule: Similarity):
    """Batches of (id, text) to (id, n, set_hash, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, shingles, sizes in shingle_sets(batch.column(1), rule.words):
                hashes = signed(_set_hashes(shingles, sizes))
                ids = batch.column(0).slice(first, last - first)
                yield pa.record_batch(
                    [ids, pa.array(sizes), pa.array(hashes), pa.array(_counts(shingles, sizes), pa.binary())],
                    names=["_id", "n", "set_hash", "counts"],
                )

    return run


def _cells_of(rule: Similarity):
    """Batches of (text) to (cell, set_hash); a set seen before in this task is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, shingles, sizes in shingle_sets(batch.column(0), rule.words):
                hashes = _set_hashes(shingles, sizes)
                fresh = np.zeros(len(sizes), bool)
                for row, value in enumerate(hashes.tolist()):
                    if value not in seen:
                        seen.add(value)
                        fresh[row] = True
                if len(seen) > _SEEN_SETS:
                    seen.clear()
                places, cells = _cells(shingles[np.repeat(fresh, sizes)], sizes[fresh], rule)
                if len(places):
                    own = signed(hashes[fresh][places])
                    yield pa.record_batch([pa.array(signed(cells)), pa.array(own)], names=["cell", "set_hash"])

    return run


def _shared_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in (cell, set_hash) order to those of cells with several sets, numbered off in blocks.

    Nothing of a cell but its last set and a count is held.
    """
    cell, last, nth = None, None, 0
    for batch in batches:
        cells, sets = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if not len(cells):
            continue
        if cell is not None:
            cells, sets = np.append(cell, cells), np.append(last, sets)
        new_cell = np.append(True, cells[1:] != cells[:-1])
        fresh = new_cell | np.append(True, sets[1:] != sets[:-1])
        cells, sets, new_cell = cells[fresh], sets[fresh], new_cell[fresh]
        begin = np.maximum.accumulate(np.where(new_cell, np.arange(len(cells)), 0))
        number = np.arange(len(cells)) - begin
        if cell is not None:
            number[begin == 0] += nth
        # a row goes out when it, or the next one, is not the first of its cell
        out = (number > 0) | np.append(number[1:] > 0, False)
        if cell is not None and nth > 0:
            out[0] = False
        cell, last, nth = cells[-1], sets[-1], int(number[-1])
        if out[-1] and nth == 0:
            out[-1] = False
        if out.any():
            yield pa.record_batch(
                [pa.array(cells[out]), pa.array((number[out] // CELL_BLOCK).astype(np.int32)), pa.array(sets[out])],
                names=["cell", "block", "set_hash"],
            )


def _near(n: int, x: bytes, m: int, y: bytes, rule: Similarity) -> bool:
    """Whether sets of these sizes and points can be linked."""
    if min(n, m) * 100 < max(n, m) * rule.percent:
        return False
    groups = min(len(x), len(y))
    return bool(_bounds(_folded(y, groups)[None, :], _folded(x, groups))[0] >= rule.overlap(n + m))


def _pairs_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shared cells, in order, with the cells of two sets turned into pairs (``set_hash``, ``other``).

    Only the rows of the last cell are held, two at most.
    """
    names, large = ["cell", "block", "set_hash", "other"], None
    held = (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))

    def out(rows, two: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        cells, blocks, sets = rows
        begin = starts[two]
        if len(begin):
            pairs = np.unique(np.stack([sets[begin], sets[begin + 1]]), axis=1)
            blank = pa.nulls(pairs.shape[1])
            yield pa.record_batch([blank.cast(pa.int64()), blank.cast(pa.int32()), pa.array(pairs[0]), pa.array(pairs[1])], names=names)
        rest = ~np.repeat(two, counts)
        if rest.any():
            own = [pa.array(x[rest]) for x in (cells, blocks, sets)]
            yield pa.record_batch([*own, pa.nulls(int(rest.sum()), pa.int64())], names=names)

    for batch in batches:
        rows = tuple(np.append(h, batch.column(k).to_numpy(zero_copy_only=False)) for k, h in enumerate(held))
        if not len(rows[0]):
            continue
        starts = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))
        counts = np.diff(np.append(starts, len(rows[0])))
        two = (counts == 2) & (rows[0][starts] != large if large is not None else True)
        last = rows[0][-1]
        end = len(rows[0])
        if counts[-1] <= 2 and last != large:
            end = int(starts[-1])  # the next batch may have more of it
            starts, counts, two = starts[:-1], counts[:-1], two[:-1]
        else:
            large = last
        held = tuple(x[end:] for x in rows)
        yield from out(tuple(x[:end] for x in rows), two, starts, counts)
    if len(held[0]):
        yield from out(held, np.array([len(held[0]) == 2]), np.array([0]), np.array([len(held[0])]))


def _shared_and_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both steps in one Python worker: as operators of their own they would hold two for each core."""
    return _pairs_apart(_shared_cells(batches))


def _near_pairs(rule: Similarity):
    """Rows (a, n, x, b, m, y) of two sets to the links that their points allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, n, x, b, m, y = (batch.column(k).to_pylist() for k in range(6))
            kept = [k for k in range(len(a)) if _near(n[k], x[k], m[k], y[k], rule)]
            yield batch.take(pa.array(kept, pa.int64())).select([0, 3])

    return run


def _bounded_links(rule: Similarity):
    """Rows (cell, p, q, n, set_hash, counts), in that order, to links that hang together what the bound can link."""

    def close(rows: list[tuple], seen: set) -> list[tuple[int, int]]:
        rows = list(dict.fromkeys(rows))
        links = []
        if len(rows) == 2:
            (n, a, x), (m, b, y) = rows
            if (a, b) in seen or n * 100 < m * rule.percent:
                return []
            seen.add((a, b))
            return [(a, b)] if _near(n, x, m, y, rule) else []
        sizes, ids = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        labels = np.arange(len(rows))
        first, points = 0, np.empty((0, 0), np.uint8)
        for x in range(len(rows)):
            if len(rows[x][2]) != points.shape[1]:  # rows are in size order, so that points behind this one are as long or longer
                first, points = x, np.stack([_folded(r[2], len(rows[x][2])) for r in rows[x:]])
            high = int(np.searchsorted(sizes, sizes[x] * 100 // rule.percent, side="right"))
            other = x + 1 + np.flatnonzero(labels[x + 1 : high] != labels[x])
            if not len(other):
                continue
            other = other[_bounds(points[other - first], points[x - first]) >= rule.overlap(sizes[other] + sizes[x])]
            for y in other.tolist():
                if labels[y] != labels[x]:
                    pair = (int(ids[x]), int(ids[y]))
                    if pair not in seen:
                        seen.add(pair)
                        links.append(pair)
                    labels[labels == labels[y]] = labels[x]
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        key, rows = None, []
        for batch in batches:
            links = []
            for cell, p, q, *point in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if (cell, p, q) != key:
                    links += close(rows, seen) if len(rows) > 1 else []
                    key, rows = (cell, p, q), []
                    if len(seen) > _SEEN_SETS:
                        seen.clear()
                rows.append(tuple(point))
            if links:
                a, b = zip(*links)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        links = close(rows, seen) if len(rows) > 1 else []
        if links:
            a, b = zip(*links)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _members_of(rule: Similarity):
    """Batches of (family, set_hash, text) to points with their sets; a text that is not the wanted set is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            family, wanted = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, last, shingles, sizes in shingle_sets(batch.column(2), rule.words):
                right = signed(_set_hashes(shingles, sizes)) == wanted[first:last]
                ends = np.cumsum(sizes)
                rows = np.flatnonzero(right)
                if not len(rows):
                    continue
                sets = [shingles[ends[r] - sizes[r] : ends[r]] for r in rows]
                counts = _counts(shingles[np.repeat(right, sizes)], sizes[rows])
                yield pa.record_batch(
                    [
                        pa.array(family[first:last][rows]),
                        pa.array(wanted[first:last][rows]),
                        pa.array(sizes[rows]),
                        pa.array(counts, pa.binary()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    names=["family", "set_hash", "n", "counts", "members"],
                )

    return run


@dataclass
class _Page:
    """Points of one tree page in size order."""

    ids: np.ndarray
    sizes: np.ndarray
    labels: np.ndarray
    counts: np.ndarray
    sets: list[np.ndarray]

    @classmethod
    def of(cls, ids, sizes, counts: bytes, members: bytes, labels=None) -> "_Page":
        ids, sizes = np.asarray(ids, np.int64), np.asarray(sizes, np.int64)
        every, groups = np.frombuffer(members, np.uint64), _groups(sizes)
        points = zip((np.cumsum(groups) - groups).tolist(), np.cumsum(groups).tolist())
        return cls(
            ids,
            sizes,
            ids.copy() if labels is None else np.array(labels, np.int64),
            np.stack([_folded(counts[a:b], groups.min()) for a, b in points]),
            np.split(every, np.cumsum(sizes)[:-1]),
        )

    def folded(self, groups: int) -> np.ndarray:
        """The points with fewer groups, a row each."""
        return np.minimum(self.counts.reshape(len(self.ids), -1, groups).sum(axis=1, dtype=np.int64), _FULL).astype(np.uint8)

    def corner(self) -> np.ndarray:
        """Largest count of each of ``GROUPS`` groups; one that may stand for more is larger than any set."""
        most = self.folded(GROUPS).max(axis=0).astype(np.int64)
        return np.where(most == _FULL, 1 << 40, most)


def _link_pages(page: _Page, other: _Page | None, rule: Similarity, labels: np.ndarray) -> list[tuple[int, int]]:
    """Verified links inside a page, or between two, that join what was not yet joined.

    ``labels`` has those of both pages, whose own are parts of it. Points that earlier links joined are not compared
    again, so a group of many similar texts costs about one verification per text.
    """
    right = page if other is None else other
    links: list[tuple[int, int]] = []
    groups = min(page.counts.shape[1], right.counts.shape[1])
    points, far = page.folded(groups), right.folded(groups)
    for x in range(len(page.ids)):
        n = page.sizes[x]
        low = x + 1 if other is None else int(np.searchsorted(right.sizes, -(-n * rule.percent // 100), side="left"))
        high = int(np.searchsorted(right.sizes, n * 100 // rule.percent, side="right"))
        near = low + np.flatnonzero(right.labels[low:high] != page.labels[x])
        if not len(near):
            continue
        need = rule.overlap(right.sizes[near] + n)
        bound = _bounds(far[near], points[x])
        for y, least in zip(near[bound >= need].tolist(), need[bound >= need].tolist()):
            if right.labels[y] == page.labels[x]:
                continue
            small, large = sorted((page.sets[x], right.sets[y]), key=len)
            spots = np.minimum(np.searchsorted(large, small), len(large) - 1)
            if int((large[spots] == small).sum()) >= least:
                links.append((int(page.ids[x]), int(right.ids[y])))
                labels[labels == right.labels[y]] = page.labels[x]
    return links


_LINK_FIELDS = "a long, b long"
_PAGE_FIELDS = (
    "family long, page long, low long, high long, corner array<long>, "
    "ids binary, sizes binary, labels binary, counts binary, members binary"
)
_PAGE_NAMES = ["family", "page", "low", "high", "corner", "ids", "sizes", "labels", "counts", "members"]


def _build_pages(rule: Similarity):
    """Points in (family, page, n, set_hash) order to links inside pages, and to the pages of families with several."""
    schema = pa.schema(
        [("a", pa.int64()), ("b", pa.int64()), ("family", pa.int64()), ("page", pa.int64()), ("low", pa.int64())]
        + [("high", pa.int64()), ("corner", pa.list_(pa.int64()))]
        + [(name, pa.binary()) for name in _PAGE_NAMES[5:]]
    )

    def close(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, sizes, counts, members = zip(*rows)
        page = _Page.of(ids, sizes, b"".join(counts), b"".join(members))
        out = [{"a": a, "b": b} for a, b in _link_pages(page, None, rule, page.labels)] if len(ids) > 1 else []
        if key[2] > 1:
            out.append(
                {
                    "family": key[0],
                    "page": key[1],
                    "low": int(page.sizes[0]),
                    "high": int(page.sizes[-1]),
                    "corner": page.corner().tolist(),
                    "ids": page.ids.tobytes(),
                    "sizes": page.sizes.tobytes(),
                    "labels": page.labels.tobytes(),
                    "counts": b"".join(counts),
                    "members": b"".join(members),
                }
            )
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for family, page, pages, *point in zip(*columns):
                if (family, page, pages) != key:
                    if rows:
                        yield from close(key, rows)
                    key, rows = (family, page, pages), []
                rows.append(tuple(point))
        if rows:
            yield from close(key, rows)

    return run


def _compare_tiles(rule: Similarity):
    """Pages in (family, p, q, page) order to the links between the pages of each two groups p and q of pages."""

    def close(p: int, q: int, rows: list[tuple]) -> list[tuple[int, int]]:
        ids, sizes, labels = (np.frombuffer(b"".join(r[k] for r in rows), np.int64) for k in (1, 2, 3))
        labels, pages, at = labels.copy(), [], 0
        for place, own, *_, counts, members in rows:
            end = at + len(own) // 8
            page = _Page.of(ids[at:end], sizes[at:end], counts, members)
            page.labels = labels[at:end]  # a part of those of the tile, so that a link is known to all its pages
            pages.append((place // PAGE_TILE, page, page.corner()))
            at = end
        links = []
        for x, (first, page, corner) in enumerate(pages):
            for second, other, far in pages[x + 1 :]:
                if (first, second) != (p, q) or other.sizes[0] * rule.percent > page.sizes[-1] * 100:
                    continue
                both = np.minimum(corner, far).sum()
                if both >= rule.overlap(int(page.sizes[0] + other.sizes[0])):
                    links += _link_pages(page, other, rule, labels)
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def closed() -> Iterator[pa.RecordBatch]:
            links = close(*key[1:], rows) if len(rows) > 1 else []
            if links:
                yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in links])

        for batch in batches:
            for row in range(batch.num_rows):
                family, p, q, *page = (batch.column(k)[row].as_py() for k in range(9))
                if (family, p, q) != key:
                    yield from closed()
                    key, rows = (family, p, q), []
                rows.append(tuple(page))
        yield from closed()

    return run


def text_sets(docs: DataFrame, rule: Similarity, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(``_id``, n, set_hash, counts) of every document: size, hash and point of its set."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_points_of(rule), f"_id {kind}, n long, set_hash long, counts binary")


def _families(texts: DataFrame, points: DataFrame, rule: Similarity) -> DataFrame:
    """(node, root): sets that hang together by cells and bounds. ``points``: (set_hash, n, counts), one row per set."""
    cells = texts.select("_text").mapInArrow(_cells_of(rule), "cell long, set_hash long")
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "set_hash")
    path = stage_path(texts.sparkSession, "cells")
    found = stage(dealt.mapInArrow(_shared_and_pairs, "cell long, block int, set_hash long, other long"), "cells", path)
    # most cells have two sets, and most pairs meet in many cells: a pair meets its points once
    pairs = found.filter("other IS NOT NULL").select(F.col("set_hash").alias("a"), F.col("other").alias("b")).distinct()
    left, right = (points.select(F.col("set_hash").alias(key), F.col("n").alias(n), F.col("counts").alias(c)) for key, n, c in ("anx", "bmy"))
    twos = pairs.join(left, "a").join(right, "b").select("a", "n", "x", "b", "m", "y").mapInArrow(_near_pairs(rule), _LINK_FIELDS)
    shared = found.filter("other IS NULL").drop("other")
    large = shared.filter("block > 0").groupBy("cell").agg((F.max("block") + 1).alias("blocks"))
    # each block of a large cell meets every other one
    met = shared.join(large, "cell", "left").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    )
    paired = met.select("cell", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "set_hash")
    order = ["cell", "p", "q", "n", "set_hash", "counts"]
    grouped = paired.join(points, "set_hash").select(*order).repartition("cell", "p", "q").sortWithinPartitions(*order[:5])
    families = connected_components(grouped.mapInArrow(_bounded_links(rule), _LINK_FIELDS).unionByName(twos))
    remove_path(texts.sparkSession, path)  # components are checkpointed
    return families


def set_links(docs: DataFrame, sets: DataFrame, rule: Similarity, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified links (a, b) between set hashes; their components are those of all links.

    ``sets`` is the staged result of :func:`text_sets`. Jobs run when this is called.
    """
    texts = docs.filter(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(text).alias("_text")
    )
    named = sets.filter("n > 0 AND _id IS NOT NULL")
    points = named.groupBy("set_hash").agg(F.first("n").alias("n"), F.first("counts").alias("counts"))
    families = _families(texts, points, rule)
    holders = named.groupBy("set_hash").agg(F.min("_id").alias("_id"))
    wanted = cut(families.select(F.col("node").alias("set_hash"), F.col("root").alias("family")).join(holders, "set_hash"))
    path = stage_path(docs.sparkSession, "points")
    points = stage(
        texts.join(wanted.hint("shuffle_hash"), "_id")  # members are as many as the corpus has, and never broadcast
        .select("family", "set_hash", "_text")
        .mapInArrow(_members_of(rule), "family long, set_hash long, n long, counts binary, members binary"),
        "points",
        path,
    )
    loads = running(
        points.select("family", "set_hash", "n").withColumn("w", F.col("n") + POINT_LOAD),
        ["family"],
        ["n", "set_hash"],
        load=("sum", "w"),
    ).withColumn("page", F.floor((F.col("load") - F.col("w")) / PAGE_LOAD))
    pages = loads.groupBy("family").agg((F.max("page") + 1).alias("pages"))
    placed = loads.select("family", "set_hash", "page").distinct().join(pages, "family")
    dealt_points = (
        points.join(placed, ["family", "set_hash"])
        .select("family", "page", "pages", F.col("set_hash").alias("id"), "n", "counts", "members")
        .repartition("family", "page")
        .sortWithinPartitions("family", "page", "n", "id")
    )
    built = stage(dealt_points.mapInArrow(_build_pages(rule), f"{_LINK_FIELDS}, {_PAGE_FIELDS}"), "pages")
    remove_path(docs.sparkSession, path)  # the pages have all that is read on
    return built.filter("a IS NOT NULL").select("a", "b").unionByName(_between_pages(built, rule))


def _between_pages(built: DataFrame, rule: Similarity) -> DataFrame:
    """Links between the pages of a family whose sizes and corners allow one.

    Pages are compared in tiles of ``PAGE_TILE`` by ``PAGE_TILE``: a page goes to a tile once, whatever number of its pages it meets.
    """
    corners = built.filter("a IS NULL").select("family", "page", "low", "high", "corner")
    left = corners.select("family", *[F.col(c).alias(f"l_{c}") for c in corners.columns[1:]])
    right = corners.select("family", *[F.col(c).alias(f"r_{c}") for c in corners.columns[1:]])
    bound = F.aggregate(F.zip_with("l_corner", "r_corner", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    pairs = (
        left.join(right, "family")
        .filter(F.col("l_page") < F.col("r_page"))
        .filter(F.col("r_low") * rule.percent <= F.col("l_high") * 100)
        .filter(bound * (100 + rule.percent) >= (F.col("l_low") + F.col("r_low")) * rule.percent)
        .select("family", "l_page", "r_page")
    )
    tiles = pairs.withColumn("p", F.floor(F.col("l_page") / PAGE_TILE)).withColumn("q", F.floor(F.col("r_page") / PAGE_TILE))
    asked = tiles.select("family", "p", "q", F.explode(F.array("l_page", "r_page")).alias("page")).distinct()
    bodies = built.filter("a IS NULL").select("family", "page", *_PAGE_NAMES[5:])
    met = asked.join(bodies, ["family", "page"]).select("family", "p", "q", "page", *_PAGE_NAMES[5:])
    dealt = met.repartition("family", "p", "q").sortWithinPartitions("family", "p", "q", "page")
    return dealt.mapInArrow(_compare_tiles(rule), _LINK_FIELDS)


def near_duplicates(
    docs: DataFrame, rule: Similarity = Similarity(), id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Component of every document under the links: (``id_col``, n_shingles, component_id, set_hash, group_hash).

    ``component_id`` is the smallest id that links reach, the document's own included;
    ``group_hash`` names the component. Copies share a set hash and are one point of the tree.

    Defined results: null and empty texts, and texts without words, have an empty set and are
    alone in their component. A row whose id is null takes no part in any link and gets a null
    component. Rows that repeat an id are separate texts: each has its own set, and identical ones
    give identical rows. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    require(docs, id_col, text)
    sets = stage(text_sets(docs, rule, id_col, text), "sets")
    joined = connected_components(set_links(docs, sets, rule, id_col, text))
    holders = (
        sets.filter("n > 0 AND _id IS NOT NULL").groupBy("set_hash").agg(F.min("_id").alias("holder"))
    )
    classes = holders.join(joined.withColumnRenamed("node", "set_hash"), "set_hash", "left").select(
        "set_hash", "holder", F.coalesce("root", "set_hash").alias("group_hash")
    )
    lowest = classes.groupBy("group_hash").agg(F.min("holder").alias("component"))
    named = classes.join(lowest, "group_hash").select("set_hash", "group_hash", "component")
    # rows without a set get a key of their own, so that they do not meet in one task
    alone = F.col("n") == 0
    keyed = sets.select("_id", "n", "set_hash").withColumn("set_hash", F.when(alone, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.col("set_hash")))
    return keyed.join(named, "set_hash", "left").select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("_id").isNull() | alone, F.col("_id")).otherwise(F.col("component")).alias("component_id"),
        "set_hash",
        F.when(F.col("_id").isNull() | alone, F.lit(None)).otherwise(F.col("group_hash")).alias("group_hash"),
    )


def _tagged(rule: Similarity, place: int, names: list[str]):
    """Batches of whole rows with the size and hash of the set of their text added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(sizes, signed(_set_hashes(shingles, sizes))) for _, _, shingles, sizes in shingle_sets(batch.column(place), rule.words)]
            if parts:
                sizes, hashes = (pa.array(np.concatenate(x)) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([*batch.columns, sizes, hashes], names=names)

    return run


def keep_one_per_group(
    docs: DataFrame, rule: Similarity = Similarity(), id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents of a corpus with one kept of each group of near-duplicates; columns stay.

    The one with the smallest id stays; of several rows of the group with this id one stays, chosen by
    its set and text. Documents without words and rows without an id are in no group and stay.
    """
    groups = near_duplicates(docs, rule, id_col, text).withColumnRenamed(id_col, "id")
    sets = (
        groups.filter("id = component_id AND group_hash IS NOT NULL")
        .groupBy("group_hash", "id", "set_hash")
        .agg(F.count("*").alias("rows"))
    )
    kept = cut(sets.groupBy("group_hash", "id").agg(F.min(F.struct("set_hash", "rows")).alias("kept")).select("id", "kept.*"))
    size, mark = (free_name(docs, name) for name in ("n_shingles", "set_hash"))
    schema = T.StructType([*docs.schema.fields, T.StructField(size, T.LongType()), T.StructField(mark, T.LongType())])
    tagged = docs.mapInArrow(_tagged(rule, docs.columns.index(text), schema.names), schema)
    alone = F.col(id_col).isNull() | (F.col(size) == 0)

    def chosen(keys: DataFrame) -> DataFrame:
        return tagged.filter(~alone).join(keys, (tagged[id_col] == keys["id"]) & (tagged[mark] == keys["set_hash"]), "left_semi")

    # texts cross once, and are not sorted; only rows that share id and set with another are numbered
    out = chosen(kept.filter("rows = 1").hint("shuffle_hash")).unionByName(tagged.filter(alone))
    several = kept.filter("rows > 1")
    repeats = several.count()
    if repeats:
        order = free_name(docs, "order")
        same = Window.partitionBy(id_col, mark).orderBy(F.xxhash64(text))
        met = chosen(F.broadcast(several) if repeats <= _FEW_KEYS else several)
        out = out.unionByName(met.withColumn(order, F.row_number().over(same)).filter(F.col(order) == 1).drop(order))
    return out.select(*docs.columns)
