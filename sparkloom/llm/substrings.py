"""Removal of long passages that repeat across documents, by recompression.

Rounds of recompression name runs of equal words and pairs of neighbours. Every symbol falls on a left
or a right side, by a hash of its name and the round; a left symbol followed by a right one, or by its
equal, becomes one symbol. A name is a hash of what it stands for, so the same passage gets
the same names in every document without any exchange, but for the symbols at its rim.

A *boundary* between two words has an outcome: the rounds it outlives, and the names on its two sides.
Each window of words points at its highest boundary, by rounds outlived and then by the hash of
the words around. Equal windows point at the same boundary, since all that decides lies inside
them; so a window that repeats has an anchor whose surroundings repeat. Anchors are one or two in ten words:

1. anchors are matched across documents; those seen in one document only are done with,
2. documents with a shared anchor hash the whole windows that point at one, and these are matched.

Both matchings are one shuffle of (hash, document) pairs. Each task first settles what it can
see itself, so a passage that a third of all documents share sends a few rows per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.common import require
from sparkloom.llm.words import gram_hashes, mix, signed, text_buffer, word_slices

# Words on each side of a boundary that decide its outcome and are hashed into its anchor.
REACH = 3
_TABLE = 1 << 17
_LEFT, _RIGHT = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xABC98388FB8FAC03)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Name of two symbols in a row."""
    return mix(left * _LEFT + right * _RIGHT)


def _merged(left: np.ndarray, right: np.ndarray, same: np.ndarray, round_no: int) -> np.ndarray:
    """Where a round joins the symbols on both sides of a boundary: a run, or a left and a right one."""
    seed = np.uint64(round_no * 0x9E3779B1)
    left_side, right_side = (mix(s ^ seed) & np.uint64(1) for s in (left, right))
    return same & ((left == right) | ((left_side == 0) & (right_side == 1)))


def _outlived(hashes: np.ndarray, text_no: np.ndarray) -> np.ndarray:
    """Rounds (0 to 2) that the boundary before each word outlives.

    The symbols beside a boundary are looked at as far as two words, so the outcome depends on two words on
    either side; only in runs of equal words is that less than the whole symbol.
    """
    n = len(hashes)
    before = np.concatenate([hashes[:1], hashes[:-1]])
    same = np.append(False, text_no[1:] == text_no[:-1]) if n else np.empty(0, bool)
    first = _merged(before, hashes, same, 1)
    joined = _pair(before, hashes)
    # the symbol that ends before a boundary, and the one that starts after it
    left = np.where(np.append(False, first[:-1]), np.append(joined[:1], joined[:-1]), before)
    right = np.where(np.append(first[1:], False), np.append(joined[1:], joined[:1]), hashes)
    second = first | _merged(left, right, same, 2)
    return (~first).astype(np.uint64) + (~second).astype(np.uint64)


def _anchors(hashes: np.ndarray, text_no: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window and the hash of the surroundings of the boundary it points at."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    around = gram_hashes(hashes, 2 * REACH)  # at a boundary's first word less REACH
    height = _outlived(hashes, text_no)[REACH : REACH + len(around)]
    rank = (height << np.uint64(62)) | (around >> np.uint64(2))
    slots = window - 2 * REACH + 1
    best, key = rank[:n].copy(), around[:n].copy()
    for k in range(1, slots):
        higher = rank[k : k + n] > best
        np.copyto(best, rank[k : k + n], where=higher)
        np.copyto(key, around[k : k + n], where=higher)
    starts = np.flatnonzero(text_no[:n] == text_no[window - 1 : window - 1 + n])
    return starts, key[starts]


class _Settled:
    """What one task has seen: for some hashes, a document that has it. Memory is fixed."""

    def __init__(self) -> None:
        self.keys, self.docs = np.zeros(_TABLE, np.uint64), np.zeros(_TABLE, np.int64)
        self.full = np.zeros(_TABLE, bool)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(_TABLE - 1)).astype(np.int64)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.slots(keys)
        return self.full[at] & (self.keys[at] == keys), self.docs[at]

    def put(self, keys: np.ndarray, docs: np.ndarray) -> None:
        at = self.slots(keys)
        self.keys[at], self.docs[at], self.full[at] = keys, docs, True


def _pairs(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, document) pairs in order, and where a key begins."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))
    keys, docs = keys[fresh], docs[fresh]
    return keys, docs, np.append(True, keys[1:] != keys[:-1])


def _rows(keys: np.ndarray, docs: np.ndarray, settled: np.ndarray) -> pa.RecordBatch:
    """Rows to be dealt by ``bucket``: the key itself, or for settled rows any other number, by key and document."""
    spread = mix(keys ^ docs.view(np.uint64))
    spread = np.where(spread == keys, ~keys, spread)
    bucket = np.where(settled, spread, keys)
    return pa.record_batch(
        [pa.array(signed(bucket)), pa.array(signed(keys)), pa.array(docs)], names=["bucket", "key", "doc"]
    )


_DEALT = "bucket long, key long, doc long"


def _shared_rows(keys: np.ndarray, docs: np.ndarray, seen: _Settled) -> pa.RecordBatch | None:
    """One slice's anchors: settled as shared where this task knows two documents with the key."""
    if not len(keys):
        return None
    keys, docs, begins = _pairs(keys, docs)
    groups = np.cumsum(begins) - 1
    several = (np.bincount(groups) > 1)[groups]
    first_keys, first_docs = keys[begins], docs[begins]
    hit, known = seen.look(first_keys)
    met = hit & (known != first_docs)
    seen.put(first_keys[~hit], first_docs[~hit])
    shared = several | met[groups]
    # a key that is shared here still sends one row, for the tasks that have it once
    plain = begins & ~hit[groups]
    out_keys = np.concatenate([keys[plain], keys[shared], first_keys[met]])
    out_docs = np.concatenate([docs[plain], docs[shared], known[met]])
    settled = np.arange(len(out_keys)) >= int(plain.sum())
    return _rows(out_keys, out_docs, settled)


def _later_rows(keys: np.ndarray, docs: np.ndarray, seen: _Settled) -> pa.RecordBatch | None:
    """One slice's windows: settled as repeated where this task knows an earlier document with the key."""
    if not len(keys):
        return None
    keys, docs, begins = _pairs(keys, docs)
    groups = np.cumsum(begins) - 1
    first_keys, first_docs = keys[begins], docs[begins]
    hit, known = seen.look(first_keys)
    earlier = hit & (known < first_docs)
    fresh = ~hit | (known > first_docs)
    seen.put(first_keys[fresh], first_docs[fresh])
    repeated = ~begins | earlier[groups]
    plain = begins & fresh[groups]
    out_keys, out_docs = np.append(keys[plain], keys[repeated]), np.append(docs[plain], docs[repeated])
    return _rows(out_keys, out_docs, np.arange(len(out_keys)) >= int(plain.sum()))


def _anchor_rows(window: int):
    """Batches of (doc, text) to rows of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Settled()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, hashes, counts in word_slices(batch.column(1)):
                text_no = np.repeat(np.arange(first, last), counts)
                starts, keys = _anchors(hashes, text_no, window)
                rows = _shared_rows(keys, ids[text_no[starts]], seen)
                if rows is not None:
                    yield rows

    return run


def _window_rows(window: int):
    """Batches of (doc, text, shared anchors, id) to rows of the windows that point at one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Settled()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            named = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            for first, last, hashes, counts in word_slices(batch.column(1)):
                text_no = np.repeat(np.arange(first, last), counts)
                starts, keys = _anchors(hashes, text_no, window)
                whole = gram_hashes(hashes, window)
                owner = text_no[starts]
                chosen = _member_rows(keys, owner, batch.column(2), first, last) & named[owner]
                rows = _later_rows(whole[starts[chosen]], ids[owner[chosen]], seen)
                if rows is not None:
                    yield rows

    return run


def _member_rows(keys: np.ndarray, owner: np.ndarray, lists: pa.Array, first: int, last: int) -> np.ndarray:
    """Which keys are in the list of their row; ``owner`` rises."""
    inside = np.zeros(len(keys), bool)
    edges = np.searchsorted(owner, np.arange(first, last + 1))
    for row in range(first, last):
        a, b = edges[row - first], edges[row - first + 1]
        if b > a and lists[row].is_valid:
            wanted = lists[row].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            inside[a:b] = np.isin(keys[a:b], wanted)
    return inside


def _matched(first_only: bool):
    """Rows in (bucket, key, doc) order to (doc, key): settled rows, and of a plain key with several documents
    all rows, or all but those of the smallest. One row of a key is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, bool] | None = None  # key, its smallest document, whether that was given out
        for batch in batches:
            bucket, key, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(key):
                continue
            settled = bucket != key
            out = [(doc[settled], key[settled])]
            key, doc = key[~settled], doc[~settled]
            if len(key):
                if held is not None:
                    key, doc = np.append(held[0], key), np.append(held[1], doc)
                begins = np.append(True, key[1:] != key[:-1])
                place = np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0))
                lowest = doc[place]
                later = doc != lowest
                given = held is not None and held[2]
                out.append((doc[later], key[later]))
                if not first_only:
                    many = np.zeros(len(key), bool)
                    many[place[later]] = True
                    if given:
                        many[0] = False
                    out.append((doc[many], key[many]))
                last = place[-1]
                tail_given = bool(later[last:].any()) or (last == 0 and given)
                held = (int(key[-1]), int(lowest[-1]), tail_given)
            docs, keys = (np.concatenate(x) for x in zip(*out))
            if len(docs):
                yield pa.record_batch([pa.array(docs), pa.array(keys)], names=["doc", "key"])

    return run


def _matches(rows: DataFrame, first_only: bool, name: str) -> DataFrame:
    """The matched keys of every document, as one list."""
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "key", "doc")
    return dealt.mapInArrow(_matched(first_only), "doc long, key long").groupBy("doc").agg(F.collect_set("key").alias(name))


def _cut_words(window: int):
    """Batches of (id, text, repeated windows) to (id, n_words, n_removed, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, texts = batch.column(2), batch.column(1)
            for first, last, hashes, counts in word_slices(texts):
                text_no = np.repeat(np.arange(first, last), counts)
                ends = np.cumsum(counts)
                whole = gram_hashes(hashes, window)
                places, raw = text_buffer(texts.slice(first, last - first))
                removed, kept = np.zeros(last - first, np.int64), []
                for k in range(last - first):
                    words = raw[places[k] : places[k + 1]].tobytes().split()
                    found = lists[first + k]
                    n = int(counts[k])
                    if found.is_valid and n >= window and batch.column(0)[first + k].is_valid:
                        wanted = found.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                        begin = int(ends[k]) - n
                        hits = np.isin(whole[begin : begin + n - window + 1], wanted)
                        steps = np.zeros(n + 1, np.int64)
                        steps[:-window][hits] += 1
                        steps[window:][hits] -= 1
                        stay = np.cumsum(steps[:-1]) == 0
                        removed[k] = n - int(stay.sum())
                        words = [words[j] for j in np.flatnonzero(stay)]
                    kept.append(b" ".join(words))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(counts.astype(np.int64)),
                        pa.array(removed),
                        pa.array(kept, pa.binary()).view(pa.string()),
                    ],
                    names=["_id", "n_words", "n_removed", "kept"],
                )

    return run


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Documents with a join key; rows without an id get one of their own, so that they do not meet in one task."""
    own, whole = F.col(id_col), F.coalesce(F.col(text), F.lit(""))
    return docs.select(own.alias("_id"), whole.alias("_text"), F.coalesce(own.cast("long"), F.xxhash64(whole)).alias("doc"))


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document without the words of passages that an earlier document has: (id, n_words, n_removed, kept).

    A passage is ``window`` consecutive words, compared exactly; a word goes when a window over it also
    starts in a document with a smaller id. Windows are judged on the input. ``kept`` has the words left,
    joined by one space. Ids are integers.

    Defined results: a null text has no words, one shorter than a window keeps them all. A row whose id is
    null keeps its words, and no other row loses words to it. Rows that repeat an id do not take words from
    each other. Other columns are not read. An empty table gives no rows.
    """
    if window <= 2 * REACH:
        raise ValueError(f"a window has more than {2 * REACH} words")
    require(docs, id_col, text)
    keyed = _keyed(docs, id_col, text)
    named = keyed.filter(F.col("_id").isNotNull()).select("doc", "_text")
    anchors = _matches(named.mapInArrow(_anchor_rows(window), _DEALT), False, "anchors")
    # both joins take the same columns of the documents, so one exchange of the texts serves both
    near = keyed.join(anchors, "doc").select("doc", "_text", "anchors", "_id")
    repeats = _matches(near.mapInArrow(_window_rows(window), _DEALT), True, "repeats")
    rows = keyed.join(repeats, "doc", "left").select("_id", "_text", "repeats")
    kind = docs.schema[id_col].dataType.simpleString()
    cut = rows.mapInArrow(_cut_words(window), f"_id {kind}, n_words long, n_removed long, kept string")
    return cut.withColumnRenamed("_id", id_col)
