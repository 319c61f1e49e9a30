"""Byte-level BPE: encoding by a priority queue of merges, decoding by concatenating vocabulary strings.

The vocabulary file is read once, where the job is planned, and broadcast; its size is that of the
vocabulary. A text is split into pieces by the pre-tokenizer's pattern. In a piece, the symbols form a
doubly linked list, and a heap holds every adjacent pair that has a merge, lowest rank first, then leftmost; an
entry whose symbols changed since it was pushed is stale and skipped. So a piece of n bytes takes
n log n steps, however long it is. Words seen before by a worker come from a bounded table, see ``word_ids``.

Short pieces that are new are merged together, see :class:`_Queues`: the lists and the queues of some thousand pieces are the rows of
arrays. A place has one entry in its piece's queue, replaced when its symbols change, and a step takes the first entry of every queue.
"""

from __future__ import annotations

import gc
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparkloom.llm.common import free_name, require
from sparkloom.llm.word_ids import WordIds

# The byte-level pre-tokenizer's pattern: a fixed value of the vocabulary format.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

_KNOWN = 400_000
_FEW = 20_000
_CHUNK = 256
_NONE = np.int32((1 << 31) - 1)  # no entry in a queue
_WIDTHS = (6, 8, 10, 12, 16, 24, 32, 64)  # bytes of pieces that are merged together
_CELLS = 1 << 16  # places in one set of queues


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, to that byte.

    Printable Latin-1 characters stand for themselves, the other bytes for the characters from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class _Queues:
    """Merges in many short pieces at once; ``ranks`` and ``wholes`` as in :class:`Vocabulary`, ``symbols`` the ids of the bytes."""

    def __init__(self, ranks: dict[tuple[int, int], int], wholes: list[int], symbols: list[int]) -> None:
        pairs = np.array(list(ranks), np.int64).reshape(-1, 2)
        self.bits = max(8, (2 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        self.wholes, self.symbols = np.array(wholes, np.int32), np.array(symbols, np.int32)
        # each pair goes to the first free slot from its own on
        keys, values = pairs[:, 0] << 32 | pairs[:, 1], np.fromiter(ranks.values(), np.int32, len(pairs))
        slots = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] == -1)
            taken = free[np.unique(slots[free], return_index=True)[1]]
            self.keys[slots[taken]], self.ranks[slots[taken]] = keys[taken], values[taken]
            rest = np.ones(len(keys), bool)
            rest[taken] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & (len(self.keys) - 1)
        self.first = self.find(np.repeat(self.symbols, 256), np.tile(self.symbols, 256)).reshape(256, 256)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; those of pairs that do not merge, or have an id below 0, are ``_NONE``."""
        keys = left.astype(np.int64) << 32 | right
        slots = self._slots(keys)
        held, ranks = self.keys[slots], self.ranks[slots]
        open_ = np.flatnonzero((held != keys) & (held != -1))
        ranks[open_] = _NONE
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slots[open_]]
            same = held == keys[open_]
            ranks[open_[same]] = self.ranks[slots[open_[same]]]
            open_ = open_[~same & (held != -1)]
        return ranks

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of at most ``_WIDTHS[-1]`` bytes, as 32-bit numbers."""
        found = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        group = np.searchsorted(_WIDTHS, lengths)
        for k, width in enumerate(_WIDTHS):
            rows = np.flatnonzero(group == k)
            for first in range(0, len(rows), step := _CELLS // width):
                own = rows[first : first + step]
                texts = [pieces[r] for r in own.tolist()]
                for r, ids in zip(own.tolist(), self._rows(texts, lengths[own], width)):
                    found[r] = ids
        return found

    def _rows(self, texts: list[bytes], lengths: np.ndarray, width: int) -> list[bytes]:
        """Places 1 to ``width`` of a row are a piece; those before and behind it have no symbol (-1) and never merge."""
        n, span = len(texts), width + 2
        data = np.frombuffer(b"".join([t.ljust(width, b"\0") for t in texts]), np.uint8).reshape(n, width)
        symbols, ranks = np.full((n, span), -1, np.int32), np.full((n, span), _NONE, np.int32)
        places = np.arange(width)
        symbols[:, 1:-1] = np.where(places < lengths[:, None], self.symbols[data], -1)
        ranks[:, 1:-2] = np.where(places[1:] < lengths[:, None], self.first[data[:, :-1], data[:, 1:]], _NONE)
        at = np.arange(n * span)
        after, before, queues = at + 1, at - 1, ranks  # places of all rows, counted through
        symbol, rank, row = symbols.reshape(-1), ranks.reshape(-1), np.arange(n)
        while len(row):
            k = row * span + queues.argmin(axis=1)  # lowest rank, then leftmost
            lowest = rank[k]
            live = np.flatnonzero(lowest != _NONE)
            if len(live) < len(row):
                k, lowest, row = k[live], lowest[live], row[live]
            gone = after[k]
            far, near = after[gone], before[k]
            whole = self.wholes[lowest]
            symbol[k], symbol[gone], rank[gone] = whole, -1, _NONE
            after[k], before[far] = far, k
            rank[k] = self.find(whole, symbol[far])
            rank[near] = self.find(symbol[near], whole)
            queues = ranks if len(row) == n else ranks[row]
        kept = symbols >= 0
        ids, ends = symbols[kept].tobytes(), np.cumsum(kept.sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Vocabulary:
    """Ids, merges and byte strings of a byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.special = {x["content"]: x["id"] for x in json.loads(source).get("added_tokens", [])}
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile("|".join(f"({regex.escape(x)})" for x in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self._known: dict[str, bytes] = {}
        self.words = WordIds(lambda words: self._ids([f" {w}" for w in words]), self._ids, [], _KNOWN // 2)

    @cached_property
    def strings(self) -> dict[int, bytes]:
        """The bytes of each id; only decoding needs them."""
        to_byte = byte_symbols()
        strings = {n: bytes(to_byte[c] for c in token) for token, n in json.loads(self.source)["model"]["vocab"].items()}
        return strings | {n: content.encode() for content, n in self.special.items()}

    @cached_property
    def ranks(self) -> dict[tuple[int, int], int]:
        """The rank of each pair of ids that merges; only encoding needs them."""
        model = json.loads(self.source)["model"]
        ids, ranks = model["vocab"], {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            ranks.setdefault((ids[left], ids[right]), rank)
        return ranks

    @cached_property
    def wholes(self) -> list[int]:
        """The id that each rank makes."""
        model = json.loads(self.source)["model"]
        return [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]

    @cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(rank, id of the whole) of each pair of ids that merges."""
        return {pair: (rank, self.wholes[rank]) for pair, rank in self.ranks.items()}

    @cached_property
    def bytes(self) -> list[int]:
        """The id of each byte."""
        ids = json.loads(self.source)["model"]["vocab"]
        return [ids[symbol] for symbol, _ in sorted(byte_symbols().items(), key=lambda x: x[1])]

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece. An entry of the queue is a rank and a place; it is stale if the pair at this place has another rank."""
        symbols = list(map(self.bytes.__getitem__, piece.encode("utf-8", "surrogatepass")))
        n, find, wholes = len(symbols), self.ranks.get, self.wholes
        shift = n.bit_length()
        mask = (1 << shift) - 1
        ranks = [*map(find, zip(symbols, symbols[1:])), None]
        queue = [rank << shift | k for k, rank in enumerate(ranks) if rank is not None]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            k = entry & mask
            if ranks[k] != entry >> shift:
                continue  # stale
            gone = after[k]
            symbols[k] = whole = wholes[entry >> shift]
            symbols[gone], ranks[gone], ranks[k] = -1, None, None
            far = after[k] = after[gone]
            if far < n:
                before[far] = k
                ranks[k] = rank = find((whole, symbols[far]))
                if rank is not None:
                    heapq.heappush(queue, rank << shift | k)
            near = before[k]
            if near >= 0:
                ranks[near] = rank = find((symbols[near], whole))
                if rank is not None:
                    heapq.heappush(queue, rank << shift | near)
        return [s for s in symbols if s >= 0]

    @cached_property
    def queues(self) -> _Queues:
        """Merges of many pieces at once."""
        return _Queues(self.ranks, self.wholes, self.bytes)

    def merge_all(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces as 32-bit numbers: short ones are merged together, a long one by a queue of its own."""
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        short = [k for k, d in enumerate(data) if len(d) <= _WIDTHS[-1]]
        if len(short) < len(data):
            found = [b"" if len(d) <= _WIDTHS[-1] else array("i", self.merge(p)).tobytes() for p, d in zip(pieces, data)]
            for k, ids in zip(short, self.queues.merge([data[k] for k in short])):
                found[k] = ids
            return found
        return self.queues.merge(data)

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        known = self._known
        if len(known) > _FEW:
            known.clear()
        parts = list(map(self.pieces.findall, texts))
        missing = list(set().union(*parts).difference(known))
        known.update(zip(missing, self.merge_all(missing)))
        found = [known[p[0]] if len(p) == 1 else b"".join([known[x] for x in p]) for p in parts]
        if any(len(p) > _WIDTHS[-1] for p in missing):
            known.clear()  # long ones are not kept
        return found

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts; special tokens in them are taken as such."""
        parts, owners = [], []
        for k, text in enumerate(texts):
            cut = self.cut.split(text) if any(s in text for s in self.special) else [text]
            owners += [k] * len(cut)
            parts += [p or "" for p in cut]
        plain = iter(self.words.encode([p for p in parts if p not in self.special]))
        found: list[list] = [[] for _ in texts]
        for k, part in zip(owners, parts):
            found[k].append(array("i", [self.special[part]]).tobytes() if part in self.special else next(plain))
        return [np.frombuffer(b"".join(f), np.int32) for f in found]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; special tokens in it are taken as such."""
        return self.encode_texts([text])[0]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings in a row; ids outside the vocabulary stand for nothing."""
        try:
            whole = b"".join(map(self.strings.__getitem__, ids))
        except KeyError:
            whole = b"".join(self.strings.get(n, b"") for n in ids)
        return whole.decode("utf-8", "replace")


def read_vocabulary(spark: SparkSession, path: str):
    """A vocabulary file, broadcast as text."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


_loaded: dict[int, Vocabulary] = {}


def _load(shared) -> Vocabulary:
    """The vocabulary of a broadcast text, built once per worker."""
    key = hash(shared.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(shared.value)
    return _loaded[key]


def _encoder(shared, place: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _load(shared)
        gc.disable()  # words by the million, and no cycles
        try:
            for whole in batches:
                for first in range(0, whole.num_rows, _CHUNK):
                    batch = whole.slice(first, _CHUNK)
                    ids = vocabulary.encode_texts([t or "" for t in batch.column(place).to_pylist()])
                    offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                    yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=names)
        finally:
            gc.enable()

    return run


def _decoder(shared, place: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _load(shared)
        for whole in batches:
            for first in range(0, whole.num_rows, _CHUNK):
                batch = whole.slice(first, _CHUNK)
                lists = batch.column(place)
                values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                texts = [
                    vocabulary.decode(values[a:b].tolist()) if valid else None
                    for a, b, valid in zip(offsets, offsets[1:], lists.is_valid().to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return run


def encode(docs: DataFrame, shared, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the array of ids of ``text``; ``shared`` is from :func:`read_vocabulary`.

    Defined results: a null or empty text has no ids; a column that is already called like the output is replaced;
    rows are independent, so repeated rows and empty tables need no rule. No row leaves its partition.
    """
    require(docs, text)
    rows, name = _without(docs, ids, text)
    schema = T.StructType([*rows.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    out = rows.mapInArrow(_encoder(shared, rows.columns.index(name), schema.names), schema)
    return out if name == text else out.drop(name)


def decode(rows: DataFrame, shared, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids. Null ids give null; bytes that are no UTF-8 give U+FFFD."""
    require(rows, ids)
    rows, name = _without(rows, text, ids)
    schema = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])
    out = rows.mapInArrow(_decoder(shared, rows.columns.index(name), schema.names), schema)
    return out if name == ids else out.drop(name)


def round_trip(docs: DataFrame, shared, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` without ``text``, with its ids and the text that :func:`decode` makes of them.

    Both steps run in one Python worker: as operators of their own they would hold two for each core, with a vocabulary in
    each, and every id would cross twice. What :func:`encode` defines holds here; a null text has no ids, and decodes to an empty one.
    """
    require(docs, text)
    if len({text, ids, decoded}) < 3:
        raise ValueError("text, ids and decoded need names of their own")
    rows = docs.drop(ids, decoded)
    place, kept = rows.columns.index(text), [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    encoder, decoder = _encoder(shared, place, [*rows.columns, ids]), _decoder(shared, len(kept), schema.names)
    bare = [k for k in range(len(rows.columns) + 1) if k != place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoder(batch.select(bare) for batch in encoder(batches))

    return rows.mapInArrow(run, schema)


def _without(df: DataFrame, output: str, source: str) -> tuple[DataFrame, str]:
    """``df`` without a column that the output replaces; the input keeps a name."""
    if output not in df.columns:
        return df, source
    if output != source:
        return df.drop(output), source
    name = free_name(df, source)
    return df.withColumnRenamed(source, name), name


def ids_digest(ids: str = "ids"):
    """Digest of the decimal ids, joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
