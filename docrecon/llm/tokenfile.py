"""Token ids in binary files: one zstandard frame a document, one dictionary for all, and an index of offsets a file.

A folder holds

- `dictionary-<hash>.zdict`: trained on serialized id arrays; <hash> is the start of its SHA-256,
- `ids-<task>-<attempt>.tok`: MAGIC, the frames end to end, the index, the footer,
- `manifest.json`: the files in the order of their documents, the number of documents and ids of each; written last, by the
  driver, so that files of lost or repeated task attempts are never read.

A frame holds a document's ids as little-endian unsigned integers of the width (2 or 4 bytes) that the manifest names, its
end id among them. The index is four arrays: doc_id, whether it is null, the frame's offset, the number of ids. The footer is the
dictionary's SHA-256, the offset of the index, the number of documents and the CRC-32 of the index.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import file_system, free_name, lines, read_file, scratch_path
from .mixing import chance
from .tokens import ByteIds, UnitIds, public_path, vocabulary

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
MAGIC = b"TOKIDS01"
_FOOTER = struct.Struct("<32sQQI8s")
LEVEL = 3
#: The dictionary is trained on about so many documents, a window of at most so many ids of each; only the sizes of files depend on it.
SAMPLE_DOCUMENTS, SAMPLE_IDS, DICTIONARY_BYTES = 2000, 2048, 64 << 10
#: Bytes of ids that a reader gives to Spark at once (a longer document goes alone).
BATCH_BYTES = 4 << 20


def _units(path: str, _held={}) -> UnitIds:  # noqa: B006 - one a worker, as it remembers
    if path not in _held:
        _held[path] = UnitIds(vocabulary(ByteIds, path, False))
    return _held[path]


def train_dictionary(arrays: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of serialized id arrays; empty where there is too little to learn from."""
    total = sum(map(len, arrays))
    if len(arrays) < 16 or total < 16 << 10:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 8), arrays).as_bytes()
    except zstandard.ZstdError:  # the library refuses arrays that are too few or too much alike
        return b""


class Frames:
    """Compresses and reads documents' ids with the shared dictionary."""

    def __init__(self, dictionary: bytes, width: int):
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.packer, self.reader = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)
        self.kind = np.dtype(f"<u{width}")

    def pack(self, ids: np.ndarray) -> bytes:
        return self.packer.compress(ids.astype(self.kind).tobytes())

    def ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.reader.decompress(frame), self.kind).astype("<u4")


@dataclass
class _Shard(WriterCommitMessage):
    task: int
    name: str
    documents: int
    ids: int


class _Writer(DataSourceArrowWriter):
    """Writes rows (doc_id, text) in the order in which they come: one file a task."""

    def __init__(self, options: dict[str, str]):
        self.path, self.vocabulary, self.dictionary = options["path"].rstrip("/"), options["vocabulary"], options["dictionary"]
        self.end, self.width = int(options["end_id"]), int(options["width"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task, units = TaskContext.get().partitionId(), _units(self.vocabulary)
        fs, folder = file_system(self.path)
        shared = read_file(fs, f"{folder}/{self.dictionary}") if self.dictionary else b""
        frames, name, parts, at, ids = Frames(shared, self.width), "", [], len(MAGIC), 0
        out = None
        for b in lines(iterator):
            if out is None:
                name = f"ids-{task:06d}-{uuid.uuid4().hex}.tok"
                out = fs.open_output_stream(f"{folder}/{name}")
                out.write(MAGIC)
            flat, ends = units.of(b.column("text"))
            own = [frames.pack(np.append(flat[i:j], self.end)) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            size, n, doc = np.fromiter(map(len, own), np.int64, len(own)), np.diff(ends) + 1, b.column("doc_id")
            parts.append((doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), at + np.cumsum(size) - size, n))
            out.write(b"".join(own))
            at, ids = at + int(size.sum()), ids + int(n.sum())
        if out is None:
            return _Shard(task, "", 0, 0)
        index = [np.concatenate(x) for x in zip(*parts, strict=True)]
        raw = b"".join(x.astype(t).tobytes() for x, t in zip(index, _INDEX, strict=True))
        out.write(raw + _FOOTER.pack(hashlib.sha256(shared).digest(), at, len(index[0]), zlib.crc32(raw), MAGIC))
        out.close()
        return _Shard(task, name, len(index[0]), ids)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        fs, folder = file_system(self.path)
        shards = sorted((m for m in messages if m and m.documents), key=lambda m: m.task)
        shared = read_file(fs, f"{folder}/{self.dictionary}") if self.dictionary else b""
        about = {"vocabulary": self.vocabulary.rpartition("/")[2], "end_id": self.end, "width": self.width, "dictionary": self.dictionary, "dictionary_sha256": hashlib.sha256(shared).hexdigest()}
        with fs.open_output_stream(f"{folder}/manifest.json") as f:
            f.write(json.dumps(about | {"files": [[m.name, m.documents, m.ids] for m in shards]}).encode())

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        """What attempts have written stays unread, as no manifest names it."""


#: The index arrays: doc_id, null or not, offset, number of ids.
_INDEX = ("<i8", "<u1", "<u8", "<u8")


def _index(f, dictionary_sha256: str) -> tuple[list[np.ndarray], int]:
    """The index of an open file, and where its frames end. The dictionary must be the one that the frames were packed with."""
    size = f.size()
    f.seek(size - _FOOTER.size)
    digest, at, n, crc, magic = _FOOTER.unpack(f.read(_FOOTER.size))
    if magic != MAGIC or digest.hex() != dictionary_sha256:
        raise ValueError("not a file of token ids, or one of another dictionary")
    f.seek(at)
    raw = f.read(size - _FOOTER.size - at)
    if zlib.crc32(raw) != crc:
        raise ValueError("the index of a file of token ids is damaged")
    out, start = [], 0
    for kind in map(np.dtype, _INDEX):
        out.append(np.frombuffer(raw, kind, n, start))
        start += n * kind.itemsize
    return out, at


@dataclass
class _Part(InputPartition):
    name: str
    start: int


class _Reader(DataSourceReader):
    """Rows (doc_id, start, n_tokens, ids), one file a partition."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        fs, folder = file_system(self.path)
        out, start = [], 0
        for name, _, ids in json.loads(read_file(fs, f"{folder}/manifest.json"))["files"]:
            out.append(_Part(name, start))
            start += ids
        return out or [_Part("", 0)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        fs, folder = file_system(self.path)
        about = json.loads(read_file(fs, f"{folder}/manifest.json"))
        frames = Frames(read_file(fs, f"{folder}/{about['dictionary']}") if about["dictionary"] else b"", about["width"])
        with fs.open_input_file(f"{folder}/{part.name}") as f:
            (doc, null, offset, n), end = _index(f, about["dictionary_sha256"])
            offset = np.append(offset.astype(np.int64), end)
            start, i = part.start + np.concatenate([[0], np.cumsum(n.astype(np.int64))]), 0
            while i < len(doc):
                j = max(i + 1, int(np.searchsorted(start, start[i] + BATCH_BYTES // 4, "right")) - 1)
                f.seek(int(offset[i]))
                raw = f.read(int(offset[j] - offset[i]))
                cut = (offset[i : j + 1] - offset[i]).tolist()
                ids = [frames.ids(raw[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                if [len(x) // 4 for x in ids] != n[i:j].tolist():
                    raise ValueError(f"{part.name}: a document has not the ids that the index counts")
                yield pa.record_batch([pa.array(doc[i:j], mask=null[i:j].astype(bool)), pa.array(start[i:j]), pa.array(n[i:j].astype(np.int64)), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                i = j


class TokenFiles(DataSource):
    """The format `token_ids`: reads a folder of such files; write() below writes one."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def _windows(path: str, end: int, width: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(path)
        for b in lines(batches):
            flat, at = units.of(b.column(0))
            rows = []
            for i, j, u in zip(at[:-1].tolist(), at[1:].tolist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(flat[i:j], end).astype(f"<u{width}")
                first = int(u * max(1, len(ids) - most + 1))
                rows.append(ids[first : first + most].tobytes())
            yield pa.record_batch([pa.array(rows, pa.binary())], names=["ids"])

    return run


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode all rows of docs and write their ids, in ascending order of id_col, as the files that the module describes.

    Texts are encoded whole, once; each is followed by end_id, so that a null or empty text is the end id alone. Rows without an
    id come first. Rows that repeat an id stay, ordered by a hash of their text. Rows are dealt to tasks by ranges of (id, hash,
    row), so a frequent id is divided; a task streams its range into one file. A very long text is one frame. An empty table gives a
    manifest without files. The dictionary is trained on about SAMPLE_DOCUMENTS documents drawn by hash (twice as many at the
    very most), a window of SAMPLE_IDS ids of each. tokenizer is the path of a byte-level tokenizers file.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or public_path(VOCABULARY)
    width = 2 if max(vocabulary(ByteIds, tokenizer, False).size - 1, end_id) < 1 << 16 else 4
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    share = SAMPLE_DOCUMENTS / max(1, rows.count())
    drawn = rows.select("text", chance(F.lit("ids"), F.monotonically_increasing_id()).alias("u"))
    drawn = drawn.filter(F.col("u") < share).select("text", (F.col("u") / share).alias("u"))  # spread over its own range anew
    windows = drawn.mapInArrow(_windows(tokenizer, end_id, width, SAMPLE_IDS), "ids binary").limit(2 * SAMPLE_DOCUMENTS)
    shared = train_dictionary([bytes(r[0]) for r in windows.collect()])
    fs, folder = file_system(path)
    fs.create_dir(folder, recursive=True)
    name = f"dictionary-{hashlib.sha256(shared).hexdigest()[:16]}.zdict" if shared else ""
    if shared:
        with fs.open_output_stream(f"{folder}/{name}") as f:
            f.write(shared)
    h, k = free_name(rows, "h"), free_name(rows, "k")
    keyed = rows.withColumn(h, F.xxhash64("text")).withColumn(k, F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col(h), F.col(k)]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    spark.dataSource.register(TokenFiles)
    ordered.write.format("token_ids").mode("append").option("path", path).option("vocabulary", tokenizer).option("dictionary", name).option("end_id", str(end_id)).option("width", str(width)).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document of a folder; ids are little-endian unsigned 32-bit numbers."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_ids").load(path)


def document(path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents of one id, by the indexes: only their frames are read. A helper for looking into a folder."""
    fs, folder = file_system(path.rstrip("/"))
    about = json.loads(read_file(fs, f"{folder}/manifest.json"))
    frames, out = Frames(read_file(fs, f"{folder}/{about['dictionary']}") if about["dictionary"] else b"", about["width"]), []
    for name, _, _ in about["files"]:
        with fs.open_input_file(f"{folder}/{name}") as f:
            (doc, null, offset, _), end = _index(f, about["dictionary_sha256"])
            offset = np.append(offset.astype(np.int64), end)
            for i in np.flatnonzero((doc == doc_id) & (null == 0)).tolist():
                f.seek(int(offset[i]))
                out.append(frames.ids(f.read(int(offset[i + 1] - offset[i]))))
    return out


def op13_token_ids(spark, sf_dir: str) -> DataFrame:
    """The whole documents table, written as files and read back."""
    path = scratch_path(spark, "token-ids")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
