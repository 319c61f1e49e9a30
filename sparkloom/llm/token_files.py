"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length coding, control bytes apart.

Ids are counted over the whole corpus and replaced by their rank, so that frequent ids are small numbers. A rank takes
one to four bytes. Its length, less one, stands in two bits of a control byte; the control bytes of a block lie
together, before its data bytes. So a block is decoded without branches: a table of 256 entries gives the lengths that
a control byte stands for, their running sum the places of the data bytes, another table the mask of each length,
and a third the id of each rank.

A block holds whole documents, in order:

    magic, part, ids of the part before this block, documents, ids, data bytes   (little-endian, see ``_HEADER``)
    ids of the documents (64 bits each), which of them are null (1 bit each), lengths of the documents (64 bits each)
    control bytes, data bytes

Files are written by Spark's own writer, a block per record, each followed by one newline, and read as whole files of
bounded size; so any file system that Spark reaches will do, and files of failed attempts are never seen. Beside the data lie two small
tables: ``ranks`` (rank, id), as long as the vocabulary, and ``parts`` (part, ids, start), a row per written partition.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from sparkloom.llm.bpe import byte_symbols
from sparkloom.llm.common import require
from sparkloom.llm.word_ids import LATIN, WordIds
from sparkloom.session import remove_path, stage_path

_MAGIC = b"TKF1"
_HEADER = "<4sqqqqq"
_BATCH_BYTES = 1 << 20

# Lengths, less one, of the four ranks of a control byte; bits of a rank by its length less one.
_LENGTHS = (np.arange(256)[:, None] >> (2 * np.arange(4)) & 3).astype(np.uint8) + np.uint8(1)
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)

# Words that are one piece, alone or behind a space, and the characters that stand for the bytes of their letters beyond ASCII.
_LATIN = re.compile(f"[{LATIN}]+")
_BYTE_SYMBOLS = {b: symbol for symbol, b in byte_symbols().items() if b >= 128}


@dataclass(frozen=True)
class Layout:
    """Blocks of about ``block_ids`` ids (more only for one longer document), at most ``file_blocks`` of them in a file.

    A vocabulary of more than ``max_vocabulary`` ids is an error, since tasks hold the rank of every id.
    """

    block_ids: int = 1 << 18
    file_blocks: int = 64
    max_vocabulary: int = 1 << 22


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of ranks below 2**32."""
    ranks = ranks.astype("<u4", copy=False)
    over = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = over
    quads = padded.reshape(-1, 4) << (2 * np.arange(4, dtype=np.uint8))
    control = np.bitwise_or.reduce(quads, axis=1) if len(quads) else np.empty(0, np.uint8)
    held = np.arange(4, dtype=np.uint8) <= over[:, None]
    return control, ranks.view(np.uint8).reshape(-1, 4)[held]


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ranks of control and data bytes."""
    lengths = _LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    padded = np.zeros(len(data) + 3, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data),), "<u4", padded, strides=(1,))
    return words[ends - lengths] & _MASKS[lengths - 1]


def write_block(part: int, before: int, doc_ids: list, lengths: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    blank = np.packbits(np.array([d is None for d in doc_ids], bool))
    head = struct.pack(_HEADER, _MAGIC, part, before, len(doc_ids), len(ranks), len(data))
    return b"".join([head, known.tobytes(), blank.tobytes(), np.array(lengths, "<i8").tobytes(), control.tobytes(), data.tobytes()])


@dataclass
class Block:
    part: int
    before: int
    doc_ids: np.ndarray
    blank: np.ndarray
    lengths: np.ndarray
    control: np.ndarray
    data: np.ndarray

    @property
    def ids(self) -> int:
        return int(self.lengths.sum())


def read_blocks(content: bytes) -> Iterator[Block]:
    """The blocks of a file's bytes, still packed."""
    at = 0
    while at < len(content):
        magic, part, before, docs, ids, size = struct.unpack_from(_HEADER, content, at)
        if magic != _MAGIC:
            raise ValueError("not a block of token ids")
        at += struct.calcsize(_HEADER)
        fields = []
        for kind, count in (("<i8", docs), (np.uint8, -(-docs // 8)), ("<i8", docs), (np.uint8, -(-ids // 4)), (np.uint8, size)):
            fields.append(np.frombuffer(content, kind, count, at))
            at += fields[-1].nbytes
        fields[1] = np.unpackbits(fields[1], count=docs).astype(bool)
        yield Block(part, before, *fields)
        at += 1  # the record's newline


def read_tokenizer(spark: SparkSession, path: str):
    """A tokenizer file of the tokenizers library, broadcast as text; its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


class Encoder:
    """The tokenizers library on whole texts, see :mod:`sparkloom.llm.word_ids`: each word, and what stands between words, is encoded once by a worker.

    Tokenizers that are not byte-level get whole texts.
    """

    KNOWN = 800_000  # parts that one generation may touch, of about 90 bytes each

    def __init__(self, source: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        data = json.loads(source)
        before, added = data.get("pre_tokenizer") or {}, data.get("added_tokens") or []
        self.by_words = (
            data.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in added)
        )
        size = self.library.get_vocab_size()
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)")
        self.words = WordIds(self.spaced_ids, self.text_ids, [t["content"] for t in added], self.KNOWN)
        self.spaced = np.array([(self.library.id_to_token(k) or "").startswith("\u0120") for k in range(size)])  # the byte 0x20

    def spaced_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words without spaces, each after one."""
        return self._piece_ids(words, "\u0120", self._joined_ids)

    def text_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of any texts."""
        return self._piece_ids(texts, "", self.library_ids)

    def _piece_ids(self, words: list[str], before: str, rest: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """One of Latin letters is one piece, and goes to the library's model as such, behind ``before``; ids of others come from ``rest``."""
        tokenize = self.library.model.tokenize
        latin = [w for w in words if (w.isalpha() if w.isascii() else _LATIN.fullmatch(w))]
        if self.special.search("\n".join(latin)):
            latin = [w for w in latin if not self.special.search(w)]
        ids: list[int] = []
        ends = [0]
        for word in latin:
            symbols = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_SYMBOLS)
            ids += [t.id for t in tokenize(before + symbols)]
            ends.append(4 * len(ids))
        data = array("I", ids).tobytes()
        own = [data[a:b] for a, b in zip(ends, ends[1:])]
        if len(latin) == len(words):
            return own
        found = dict(zip(latin, own))
        others = [w for w in words if w not in found]
        found.update(zip(others, rest(others)))
        return [found[w] for w in words]

    def _joined_ids(self, words: list[str]) -> list[bytes]:
        """The same for any words, from one text of many: ids that start with a space begin the next word."""
        found: list[bytes] = []
        for first in range(0, len(words), 10_000):
            some = words[first : first + 10_000]
            ids = np.frombuffer(self.library_ids([" " + " ".join(some)])[0], "<u4")
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(some):  # a vocabulary that joins other things to spaces
                found += self.library_ids([f" {w}" for w in some])
                continue
            data, ends = ids.tobytes(), [*(starts[1:] * 4).tolist(), len(ids) * 4]
            found += [data[a:b] for a, b in zip((starts * 4).tolist(), ends)]
        return found

    def library_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit numbers."""
        if not texts:
            return []
        return [np.array(f.ids, "<u4").tobytes() for f in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self.library_ids(texts)
        self.words.half = self.KNOWN
        return self.words.encode(texts)


_loaded: dict[int, Encoder] = {}


def _load(shared) -> Encoder:
    """The encoder of a broadcast tokenizer, built once per worker; its words serve the worker's later tasks."""
    key = hash(shared.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(shared.value)
    return _loaded[key]


def _narrowed(ids: np.ndarray) -> bytes:
    """Ids in two or four bytes each; the first byte says which."""
    if not len(ids) or ids.max() < 1 << 16:
        return b"\2" + ids.astype("<u2").tobytes()
    return b"\4" + ids.astype("<u4").tobytes()


def held_ids(data: bytes) -> np.ndarray:
    """The ids that a binary value of :func:`tokenize_texts` holds."""
    return np.frombuffer(data, f"<u{data[0]}", -1, 1)


_PAIR = [("id", "<u4"), ("n", "<i8")]


class _Counts:
    """How often ids occur in a task; no longer than the vocabulary."""

    def __init__(self) -> None:
        self.n = np.zeros(0, np.int64)

    def add(self, ids: np.ndarray) -> None:
        found = np.bincount(ids)
        if len(found) > len(self.n):
            found[: len(self.n)] += self.n
            self.n = found
        else:
            self.n[: len(found)] += found

    def batch(self, names: list[str]) -> pa.RecordBatch:
        """One row, its last column the pairs (id, n), the others null."""
        seen = np.flatnonzero(self.n)
        pairs = np.empty(len(seen), _PAIR)
        pairs["id"], pairs["n"] = seen, self.n[seen]
        kinds = {"doc_id": pa.int64()}
        blank = [pa.nulls(1, kinds.get(name, pa.binary())) for name in names[:-1]]
        return pa.record_batch([*blank, pa.array([pairs.tobytes()], pa.binary())], names=names)


def _tokenized(shared, end_id: int | None):
    """Batches of (doc_id, text) to (doc_id, ids, counts): a row per document, and at last one with the task's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts, names = _load(shared), _Counts(), ["doc_id", "ids", "counts"]
        gc.disable()  # words by the million, and no cycles
        try:
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                first = 0
                while first < len(texts):
                    last, held = first, 0
                    while last < len(texts) and (last == first or held + len(texts[last]) <= _BATCH_BYTES):
                        held += len(texts[last])
                        last += 1
                    found = [np.frombuffer(ids + tail, "<u4") for ids in encoder.encode(texts[first:last])]
                    counts.add(np.concatenate(found))
                    ids = pa.array([_narrowed(x) for x in found], pa.binary())
                    yield pa.record_batch([batch.column(0).slice(first, last - first), ids, pa.nulls(last - first, pa.binary())], names=names)
                    first = last
        finally:
            gc.enable()
        yield counts.batch(names)

    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    return run


def tokenize_texts(docs: DataFrame, shared, end_id: int | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, counts): ids of every whole text, special tokens in it taken as such, and ``end_id`` behind them.

    ``ids`` is binary, see :func:`held_ids`. Every task adds a row without ids, in which ``counts`` says how often it
    used each id. ``shared`` is from :func:`read_tokenizer`. A null text is empty.
    """
    require(docs, id_col, text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_tokenized(shared, end_id), "doc_id long, ids binary, counts binary")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (counts) to (id, n)."""
    for batch in batches:
        for counts in batch.column(0).to_pylist():
            pairs = np.frombuffer(counts, _PAIR)
            yield pa.record_batch([pa.array(pairs["id"].astype(np.int64)), pa.array(pairs["n"].copy())], names=["id", "n"])


def rank_ids(rows: DataFrame, layout: Layout = Layout()) -> np.ndarray:
    """The ids of :func:`tokenize_texts`, most frequent first, then smallest. No longer than the vocabulary."""
    held = rows.filter("counts IS NOT NULL").select("counts")
    counts = held.mapInArrow(_pairs, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.limit(layout.max_vocabulary + 1).toPandas()
    if len(found) > layout.max_vocabulary:
        raise ValueError(f"more than {layout.max_vocabulary} distinct ids")
    return found.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32)


def _packed(shared, layout: Layout):
    """Batches of (doc_id, ids), in order, to blocks of this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = shared.value
        ranks = np.zeros(int(ranked.max()) + 1 if len(ranked) else 0, np.uint32)
        ranks[ranked] = np.arange(len(ranked), dtype=np.uint32)
        part, before = TaskContext.get().partitionId(), 0
        doc_ids, texts, held = [], [], 0

        def close() -> pa.RecordBatch:
            lengths = [len(t) for t in texts]
            block = write_block(part, before, doc_ids, lengths, ranks[np.concatenate(texts)])
            return pa.record_batch([pa.array([block], pa.binary())], names=["block"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = held_ids(ids.as_py())
                if doc_ids and held + len(found) > layout.block_ids:
                    yield close()
                    before += held
                    doc_ids, texts, held = [], [], 0
                doc_ids.append(doc_id)
                texts.append(found)
                held += len(found)
        if doc_ids:
            yield close()

    return run


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole files to (part, ids) of their blocks."""
    for batch in batches:
        found = [(b.part, b.ids) for content in batch.column(0) for b in read_blocks(content.as_buffer())]
        if found:
            part, ids = zip(*found)
            yield pa.record_batch([pa.array(part), pa.array(ids)], names=["part", "ids"])


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{folder}/data").select("content")


def write_token_files(rows: DataFrame, folder: str, layout: Layout = Layout()) -> None:
    """Write rows of :func:`tokenize_texts` to a new folder, in ascending order of ``doc_id``, those without an id last.

    Rows that repeat an id are ordered by a hash of their ids. ``rows`` is read three times, and should be a written table. Spark's
    range partitions are the parts; a hot id is spread over several. The folder appears by Spark's commit.
    """
    require(rows, "doc_id", "ids", "counts")
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(rank_ids(rows, layout))
    order = [F.col("doc_id").asc_nulls_last(), "_mark", "_place"]
    marked = rows.filter("ids IS NOT NULL").select("doc_id", "ids", F.xxhash64("ids").alias("_mark"), F.monotonically_increasing_id().alias("_place"))
    ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    blocks = ordered.mapInArrow(_packed(shared, layout), "block binary")
    files = blocks.select(F.col("block").cast("string"))  # bytes go out as they are
    files.write.option("maxRecordsPerFile", layout.file_blocks).option("compression", "none").text(f"{folder}/data")
    ranked = [(k, int(v)) for k, v in enumerate(shared.value)]
    spark.createDataFrame(ranked, "rank int, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    totals = _contents(spark, folder).mapInArrow(_heads, "part long, ids long").groupBy("part").agg(F.sum("ids").alias("ids"))
    parts, start = [], 0
    for row in sorted(totals.collect()):  # a row per written partition
        parts.append((row["part"], row["ids"], start))
        start += row["ids"]
    spark.createDataFrame(parts, "part long, ids long, start long").coalesce(1).write.parquet(f"{folder}/parts")


def _documents(shared):
    """Batches of whole files to (doc_id, start, n_tokens, ids) of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, starts = shared.value
        for batch in batches:
            for content in batch.column(0):
                for block in read_blocks(content.as_buffer()):
                    ids = ranked[unpack(block.control, block.data, block.ids)].astype("<u4", copy=False)
                    ends = np.cumsum(block.lengths)
                    offsets = np.append(0, ends) * 4
                    yield pa.record_batch(
                        [
                            pa.array(block.doc_ids, mask=block.blank),
                            pa.array(starts[block.part] + block.before + ends - block.lengths),
                            pa.array(block.lengths),
                            pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)]),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in a folder of :func:`write_token_files`.

    ``start`` counts the ids of all documents before it; ``ids`` is binary, little-endian numbers of 32 bits.
    """
    ranked = spark.read.parquet(f"{folder}/ranks").toPandas().sort_values("rank")["id"].to_numpy(np.uint32)
    starts = {r["part"]: r["start"] for r in spark.read.parquet(f"{folder}/parts").collect()}
    shared = spark.sparkContext.broadcast((ranked, starts))
    return _contents(spark, folder).mapInArrow(_documents(shared), "doc_id long, start long, n_tokens long, ids binary")


def store_texts(
    docs: DataFrame, shared, end_id: int | None, folder: str, layout: Layout = Layout(), id_col: str = "doc_id", text: str = "text"
) -> None:
    """Tokenise every whole text and write the ids to ``folder``.

    Texts are tokenised once; their ids are staged, counted, and written in order.

    Defined results: a null text is empty and has the end id only. Documents without an id come last, with a null id. Rows
    that repeat an id are documents of their own. A long text is one document in one block. Other columns of ``docs`` are
    not read. An empty table gives a folder without documents. Jobs run when this is called.
    """
    spark, path = docs.sparkSession, stage_path(docs.sparkSession, "ids")
    found = tokenize_texts(docs, shared, end_id, id_col, text)
    found.write.option("compression", "zstd").parquet(path)
    write_token_files(spark.read.schema(found.schema).parquet(path), folder, layout)
    remove_path(spark, path)
