"""Operator 13: token ids in binary files, each document compressed on its own with one trained dictionary.

A folder holds ``dictionary`` (zstandard, trained on serialized ids), ``manifest`` (Parquet, a row for each file) and
``files/*``. A file is::

    magic (8 bytes), bytes of an id (1), SHA-256 of the dictionary (32)
    a zstandard frame for each document: its ids, little-endian, 2 bytes each if the vocabulary allows it, else 4
    index: doc_id (int64) of each document, whether it is null (1 byte), its number of ids (int64), the end of its frame (int64)
    place of the index (int64), number of documents (int64), CRC-32 of the index (uint32), magic

so a document is read by its frame alone. Documents are in ascending order of doc_id (nulls first), files by ranges of
it. A task writes under a name of its own and the manifest, which Spark commits, names the files that count: a lost
executor or a second attempt leaves at most a file that nothing names.

The dictionary is fitted on a sample: blocks of ``BLOCK`` bytes, about ``SAMPLE`` of all blocks of all documents, chosen
by a hash. It has a bearing on sizes only.

Defined cases: a null or empty text has the end id alone; rows equal in doc_id are ordered by their ids; repeated rows
are written as often as they come; an empty table gives a folder without files and no rows; other columns of the input
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, map_texts, table
from .packing import END_ID, encoder

MAGIC = b"TIDEIDS1"
DICTIONARY_BYTES, SAMPLE, BLOCK, FILE_BYTES, LEVEL = 64 << 10, 2048, 4096, 128 << 20, 3
FOOT = struct.Struct("<qqI8s")
MANIFEST = "file string, number int, first_doc long, last_doc long, n_docs long, n_ids long, bytes long, dictionary string"


def opened(uri: str):
    """(file system, path) of a folder's address, in any store that Arrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n, width, ids): each text's ids with the end id, serialized."""

    def work(texts: list[bytes | None], batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(tokenizer)
        ids, lens = e.encode(texts)
        width = 2 if max(len(e.ends) - 1, end_id) < 1 << 16 else 4
        ends = np.cumsum(lens)
        flat = np.insert(ids, ends, end_id).astype(f"<u{width}")
        at = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * width
        if at[-1] < 1 << 31:
            held = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)])
        else:
            held = pa.array([flat[a // width : b // width].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.large_binary())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lens + 1), pa.array(np.full(len(lens), width, np.int32)), held], ["doc_id", "n", "width", "ids"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", work, "doc_id long, n long, width int, ids binary", most=2 << 20, keeps=True)


def trained(rows: DataFrame, size: int = DICTIONARY_BYTES, sample: int = SAMPLE, block: int = BLOCK) -> bytes:
    """A dictionary for the serialized ids; empty where there is too little to train on."""
    import zstandard

    blocks = rows.select("row", "ids", F.explode(F.sequence(F.lit(0), F.floor((F.length("ids") - 1) / block))).alias("k"))
    total = rows.agg(F.sum(F.floor((F.length("ids") - 1) / block) + 1)).first()[0] or 0
    share = int(min(1.0, sample / max(total, 1)) * (1 << 62))
    chosen = blocks.where(F.shiftrightunsigned(F.xxhash64("row", "k"), 2) <= share).select(F.substring("ids", F.col("k").cast("int") * block + 1, F.lit(block)).alias("part"))
    parts = [bytes(r.part) for r in chosen.limit(2 * sample).collect()]
    try:
        return zstandard.train_dictionary(size, sorted(parts), k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _codec(dictionary: bytes) -> dict:
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


class Writer:
    """One file, document by document."""

    def __init__(self, out, width: int, dictionary: bytes, compressor):
        self.out, self.compressor = out, compressor
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.ends: list[int] = []
        self.at = out.write(MAGIC + bytes([width]) + hashlib.sha256(dictionary).digest())

    def add(self, doc: int | None, n: int, ids: bytes) -> None:
        self.at += self.out.write(self.compressor.compress(ids))
        self.docs.append(doc)
        self.sizes.append(n)
        self.ends.append(self.at)

    def close(self) -> int:
        """The file's length."""
        none = np.array([d is None for d in self.docs], np.uint8)
        index = np.array([d or 0 for d in self.docs], "<i8").tobytes() + none.tobytes() + np.array(self.sizes, "<i8").tobytes() + np.array(self.ends, "<i8").tobytes()
        foot = FOOT.pack(self.at, len(self.docs), zlib.crc32(index), MAGIC)
        self.at += self.out.write(index) + self.out.write(foot)
        self.out.close()
        return self.at


class Reader:
    """A file's documents, all in turn or one by its id."""

    def __init__(self, source, dictionary: bytes):
        import zstandard

        self.source = source
        self.head = len(MAGIC) + 33
        head = source.read_at(self.head, 0)
        place, count, crc, magic = FOOT.unpack(source.read_at(FOOT.size, source.size() - FOOT.size))
        if head[:8] != MAGIC or magic != MAGIC:
            raise ValueError("not a file of token ids")
        if head[9:] != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        index = source.read_at(count * 25, place)
        if zlib.crc32(index) != crc:
            raise ValueError("the index is damaged")
        self.kind = f"<u{head[8]}"
        self.docs = np.frombuffer(index, "<i8", count)
        self.none = np.frombuffer(index, np.uint8, count, count * 8).astype(bool)
        self.sizes = np.frombuffer(index, "<i8", count, count * 9)
        self.ends = np.frombuffer(index, "<i8", count, count * 17)
        self.decompressor = zstandard.ZstdDecompressor(**_codec(dictionary))

    def at(self, k: int) -> np.ndarray:
        start = int(self.ends[k - 1]) if k else self.head
        return self.ids(self.source.read_at(int(self.ends[k]) - start, start), k)

    def ids(self, frame: bytes, k: int) -> np.ndarray:
        out = np.frombuffer(self.decompressor.decompress(frame), self.kind)
        if len(out) != self.sizes[k]:
            raise ValueError("a document's frame is damaged")
        return out

    def find(self, doc: int | None) -> list[np.ndarray]:
        """The ids of each row with this doc_id."""
        if doc is None:
            return [self.at(k) for k in range(int(self.none.sum()))]
        nulls = int(self.none.sum())
        a, b = np.searchsorted(self.docs[nulls:], [doc, doc + 1]) + nulls
        return [self.at(k) for k in range(a, b)]

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Frames are read some megabytes at a time."""
        k = 0
        while k < len(self.docs):
            start = int(self.ends[k - 1]) if k else self.head
            to = max(k + 1, int(np.searchsorted(self.ends, start + (4 << 20), "right")))
            held = memoryview(self.source.read_at(int(self.ends[to - 1]) - start, start))
            at = start
            for j in range(k, to):
                end = int(self.ends[j])
                yield (None if self.none[j] else int(self.docs[j])), self.ids(held[at - start : end - start], j)
                at = end
            k = to


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the ids of (doc_id, text) to a new folder that driver and executors share; returns its manifest."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    rows = scratch.save(encoded(docs, tokenizer, end_id).withColumn("row", F.monotonically_increasing_id()))
    dictionary = trained(rows)
    store, path = opened(folder)
    store.create_dir(f"{path}/files", recursive=True)
    with store.open_output_stream(f"{path}/dictionary") as out:
        out.write(dictionary)
    total = rows.agg(F.sum(F.length("ids"))).first()[0] or 0
    files = max(total // file_bytes + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_first(), F.crc32("ids"), F.col("row")]
    told = hashlib.sha256(dictionary).hexdigest()

    def save(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, path = opened(folder)
        writer, n_ids, name = None, 0, f"{uuid.uuid4().hex}.ids"
        for batch in it:
            doc, n, width, ids = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n", "width", "ids"))
            for k in range(batch.num_rows):
                if writer is None:
                    held = _dictionary(store, path, told)
                    codec = _codec(held)
                    if codec:
                        codec["dict_data"].precompute_compress(level=LEVEL)
                    writer = Writer(store.open_output_stream(f"{path}/files/{name}"), width[k].as_py(), held, zstandard.ZstdCompressor(level=LEVEL, **codec))
                writer.add(doc[k].as_py(), n[k].as_py(), ids[k].as_buffer())
                n_ids += writer.sizes[-1]
        if writer is not None:
            known = [d for d in writer.docs if d is not None]
            row = [name, TaskContext.get().partitionId(), known[0] if known else None, known[-1] if known else None, len(writer.docs), n_ids, writer.close(), told]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [c.split()[0] for c in MANIFEST.split(", ")])

    sorted_rows = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "n", "width", "ids")
    sorted_rows.mapInArrow(save, MANIFEST).write.parquet(f"{folder}/manifest")
    scratch.drop(rows)
    return manifest(spark, folder)


def _dictionary(store, path: str, told: str) -> bytes:
    with store.open_input_file(f"{path}/dictionary") as f:
        held = f.read()
    if hashlib.sha256(held).hexdigest() != told:
        raise ValueError("the folder's dictionary isn't the one that its files were written with")
    return held


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a folder: (doc_id, start, n_tokens, ids_crc32), by one task for each file."""
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest(spark, folder).select("file", "number", "dictionary", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n = files.count()

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        for batch in it:
            for r in batch.to_pylist():
                with store.open_input_file(f"{path}/files/{r['file']}") as f:
                    rows: tuple[list, ...] = ([], [], [], [])
                    at = r["base"]
                    for doc, ids in Reader(f, _dictionary(store, path, r["dictionary"])):
                        for col, v in zip(rows, (doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            col.append(v)
                        at += len(ids)
                        if len(rows[0]) == 10_000:
                            yield _batch(rows)
                            rows = ([], [], [], [])
                    yield _batch(rows)

    return files.repartitionByRange(max(n, 1), "number").mapInArrow(work, DOCUMENTS)


def _batch(rows: tuple[list, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], [c.split()[0] for c in DOCUMENTS.split(", ")])


def ids_of(spark: SparkSession, folder: str, doc: int | None) -> list[np.ndarray]:
    """One document's ids (for each row that has its doc_id), from the frames of its files alone."""
    store, path = opened(folder)
    held = manifest(spark, folder)
    here = held.where(F.col("first_doc").isNull() | (F.lit(doc).between(F.col("first_doc"), F.col("last_doc")) if doc is not None else F.lit(True)))
    out = []
    for r in here.orderBy("number").collect():
        with store.open_input_file(f"{path}/files/{r.file}") as f:
            out += Reader(f, _dictionary(store, path, r.dictionary)).find(doc)
    return out


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{Scratch(spark, 'op13').base}/ids"
    write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read(spark, folder)
