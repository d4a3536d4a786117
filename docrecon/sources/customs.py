"""Customs files as a Spark data source, and a table of their pages by content that is only ever added to.

`customs_files` lists a folder, or takes one file, and expands archives. Partitions hold files of PARTITION_BYTES together; a
file is read by the task that parses it and its bytes go no further. A member of an archive has the path of the archive without
its extension, then its own.
"""

from __future__ import annotations

import hashlib
import importlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

PARTITION_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
#: Archives within archives that are opened.
DEPTH = 4
FILES = "path string, archive string, kind string, size long, digest string, error string"
PAGES = "path string, kind string, digest string, page_no int, text string, error string"


def usable(path: str, single: bool = False) -> bool:
    """Whether a file is read: a known extension, no system file and, in a folder, no transport copy."""
    name = path.rpartition("/")[2]
    known = name.rpartition(".")[2].lower() in {*files.KINDS, "zip"} and "." in name
    return known and not name.startswith("._") and name != ".DS_Store" and (single or not re.search("_HWB_|_AWB_|HAWB", name))


def members(content: bytes, base: str, depth: int = DEPTH) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(path, content, error) of the usable files of an archive, those of archives within it too. A member that can't be read has an error, and the others go on."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except Exception as e:  # noqa: BLE001 - the error is the row
        yield base, None, f"{type(e).__name__}: {e}"
        return
    with archive:
        for info in archive.infolist():
            parts = [p for p in info.filename.replace("\\", "/").split("/") if p not in ("", ".", "..")]
            if info.is_dir() or not parts or "__MACOSX" in parts or parts[-1].startswith(".") or not usable(parts[-1]):
                continue
            path = "/".join([base, *parts])
            try:
                inner = archive.read(info)
            except Exception as e:  # noqa: BLE001
                yield path, None, f"{type(e).__name__}: {e}"
                continue
            if path.lower().endswith(".zip"):
                if depth:
                    yield from members(inner, path[:-4], depth - 1)
                else:
                    yield path, None, "ValueError: too many archives within archives"
            else:
                yield path, inner, None


@dataclass
class _Files(InputPartition):
    #: (path, the members that are wanted, or None for all)
    entries: list[tuple[str, list[str] | None]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.what, self.only = options["path"], options.get("what", "pages"), options.get("only")
        self.pdf = options.get("pdf_reader")

    def _fs(self):
        return pa.fs.FileSystem.from_uri(self.root) if ":/" in self.root else (pa.fs.LocalFileSystem(), self.root)

    def _sizes(self) -> list[tuple[str, int, list[str] | None]]:
        """(path, size, wanted members) of the files to read, in order of path."""
        fs, root = self._fs()
        if self.only:  # a table (path, archive, size) of what is wanted
            table = pq.read_table(self.only, columns=["path", "archive", "size"]).to_pylist()
            held: dict[str, tuple[int, list[str] | None]] = {}
            for r in table:
                own = held.setdefault(r["archive"] or r["path"], (r["size"] or 0, [] if r["archive"] else None))
                if r["archive"]:
                    own[1].append(r["path"])
            return sorted((p, n, w) for p, (n, w) in held.items())
        info = fs.get_file_info(root.rstrip("/"))
        if info.type == pa.fs.FileType.File:
            return [(info.path, info.size, None)] if usable(info.path, single=True) else []
        found = fs.get_file_info(pa.fs.FileSelector(root.rstrip("/"), recursive=True))
        return sorted((f.path, f.size, None) for f in found if f.type == pa.fs.FileType.File and usable(f.path))

    def partitions(self) -> list[InputPartition]:
        out, size = [[]], 0
        for path, n, wanted in self._sizes():
            if out[-1] and size + n > PARTITION_BYTES:
                out.append([])
                size = 0
            out[-1].append((path, wanted))
            size += n
        return [_Files(x) for x in out]

    def _opened(self, part: _Files) -> Iterator[tuple[str, str | None, bytes | None, str | None]]:
        """(path, archive, content, error) of each file."""
        fs, _ = self._fs()
        for path, wanted in part.entries:
            try:
                with fs.open_input_stream(path) as f:
                    content = f.read()
            except Exception as e:  # noqa: BLE001 - the error is the row
                yield path, None, None, f"{type(e).__name__}: {e}"
                continue
            if not path.lower().endswith(".zip"):
                yield path, None, content, None
                continue
            for name, inner, error in members(content, path[:-4]):
                if wanted is None or name in wanted:
                    yield name, path, inner, error

    def read(self, part: _Files) -> Iterator[pa.RecordBatch]:
        schema = [("path", pa.string()), ("archive", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("digest", pa.string()), ("error", pa.string())]
        if self.what == "pages":
            schema = [("path", pa.string()), ("kind", pa.string()), ("digest", pa.string()), ("page_no", pa.int32()), ("text", pa.string()), ("error", pa.string())]
        rows, size, pdf = [], 0, _function(self.pdf)
        for path, archive, content, error in self._opened(part):
            kind = files.KINDS.get(path.rpartition(".")[2].lower())
            digest = None if content is None else hashlib.sha256(content).hexdigest()
            if self.what == "files":
                new = [(path, archive, kind, None if content is None else len(content), digest, error)]
            elif error:
                new = [(path, kind, digest, None, None, error)]
            else:
                new = _texts(path, kind, digest, content, pdf)
            for row in new:
                rows.append(row)
                size += 100 + len(row[4] or "")
                if size > BATCH_BYTES:
                    yield _batch(rows, schema)
                    rows, size = [], 0
        yield _batch(rows, schema)


def _batch(rows: list[tuple], schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, kind) for c, (_, kind) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def _function(name: str | None) -> Callable | None:
    """A function by its place, module:name."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _texts(path: str, kind: str | None, digest: str, content: bytes, pdf: Callable | None) -> list[tuple]:
    try:
        if kind == "pdf" and pdf is None:
            raise ValueError("no reader for PDF is set")
        texts = list(files.sheets(content) if kind == "excel" else pdf(content))
        return [(path, kind, digest, i + 1, t, None) for i, t in enumerate(texts)]
    except Exception as e:  # noqa: BLE001 - the error is the row
        return [(path, kind, digest, None, None, f"{type(e).__name__}: {e}")]


class CustomsFiles(DataSource):
    """`spark.read.format("customs_files").load(root)`: pages, one row each; with what=files the files and their digests. pdf_reader names a function from bytes to page texts (module:function); only names a table of the files that are wanted."""

    @classmethod
    def name(cls) -> str:
        return "customs_files"

    def schema(self) -> str:
        return FILES if self.options.get("what") == "files" else PAGES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, root: str, what: str = "pages", pdf_reader: str | None = None, only: str | None = None) -> DataFrame:
    spark.dataSource.register(CustomsFiles)
    options = {"what": what, "pdf_reader": pdf_reader, "only": only}
    return spark.read.format("customs_files").options(**{k: v for k, v in options.items() if v}).load(root)


def read_with_table(spark: SparkSession, root: str, table: str, version: str = "1", pdf_reader: str | None = None) -> tuple[DataFrame, int]:
    """The pages of root, and how many files were parsed for them: those whose content the table has not seen under this version.

    table is a folder that this adds to: `pages`, a row for each page of a content and version (digest, version, page_no, text), and for
    each run the files that it wanted. Contents are told apart by their digest, so a copy under another name, or a second run, is never
    parsed again. Pages without any text and contents that can't be read are not kept, so that a better reader gets them. Appending
    is a Parquet write of Spark, of which a failed job leaves nothing.
    """
    found = read(spark, root, "files", pdf_reader)
    listed = f"{table}/runs/{hashlib.sha256(root.encode()).hexdigest()[:12]}"
    found.write.mode("overwrite").parquet(f"{listed}/files")
    found = spark.read.parquet(f"{listed}/files")
    store, schema = f"{table}/pages", "digest string, version string, page_no int, text string"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    held = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    known = spark.read.schema(schema).parquet(store) if held else spark.createDataFrame([], schema)
    known = known.filter(F.col("version") == version)
    new = found.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("path", "archive", "size")).alias("f")).join(known.select("digest").distinct(), "digest", "left_anti")
    new.select("f.*", "digest").write.mode("overwrite").parquet(f"{listed}/wanted")
    wanted = spark.read.parquet(f"{listed}/wanted")
    count = wanted.count()
    errors = spark.createDataFrame([], "digest string, failed string")
    if count:
        read(spark, root, "pages", pdf_reader, f"{listed}/wanted").write.mode("overwrite").parquet(f"{listed}/pages")
        parsed = spark.read.parquet(f"{listed}/pages")
        full = parsed.filter("error is null").groupBy("digest").agg(F.max(F.length(F.trim("text"))).alias("n")).filter("n > 0").select("digest")
        parsed.join(full, "digest", "left_semi").select("digest", F.lit(version).alias("version"), "page_no", "text").write.mode("append").parquet(store)
        errors = parsed.filter("error is not null").select("digest", F.col("error").alias("failed")).dropDuplicates(["digest"])
        held = True
    pages = spark.read.schema(schema).parquet(store).filter(F.col("version") == version).dropDuplicates(["digest", "page_no"]) if held else known
    out = found.join(pages.drop("version"), "digest", "left").join(errors, "digest", "left")
    return out.select("path", "kind", "digest", "page_no", "text", F.coalesce("error", "failed").alias("error")), count
