"""Alignment of two tokenizers' ids over the same bytes, and how often the corpus links their ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lines, materialise
from .tokens import ByteIds, PieceIds, Remembered, Runs, byte_pieces, public_path, unit_slots, vocabulary

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Documents of a slice, which numbers its documents in 16 bits.
SLICE = 4000
#: Postings of a B id that go to one group of the cogroup; an id with more is dealt over several groups.
HOT = 1_000_000
#: Links' counts and documents' contributions that a task gathers before it sums them up.
GATHERED = 2_000_000


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


class Aligned(Remembered):
    """Units with their ids on both sides: where both sides' tokens end, a group ends, and a unit's end is such a place."""

    most_units, most_chars = 300_000, 6_000_000

    def __init__(self, a: ByteIds, b: PieceIds):
        self.a, self.b = a, b
        self.cut = a.cut and b.cut
        pieces = byte_pieces(a.tokenizer)
        self.bytes_a, self.bytes_b = [pieces.get(i, "").encode("latin-1") for i in range(a.size)], [b.pieces[i] for i in range(b.size)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.shown = [f"{i}{e}" for i in range(a.size) for e in ",|"] + [f"{i}{e}" for i in range(b.size) for e in ",;"]
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.groups: list[str] = []  # each group with its closing mark
        self.pairs = Runs(np.int64)  # of each link: B id in the upper 32 bits, A id in the lower
        self.right, self.n = np.zeros(0, bool), np.zeros((4, 0), np.int64)  # n: A tokens, B tokens, groups, links

    def learn(self, units: list[str]) -> None:
        ids_a, ids_b = self.a.encode(units), self.b.encode(units)
        to_a, to_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        raw = [u.encode() for u in units]
        right = np.array([b"".join(map(to_a, x)) == r == b"".join(map(to_b, y)) for x, y, r in zip(ids_a, ids_b, raw, strict=True)], bool)
        size = np.where(right, [len(r) for r in raw], 0)
        n_a, n_b = (np.array([len(x) if ok else 0 for x, ok in zip(ids, right, strict=True)], np.int64) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.array([i for x, ok in zip(ids, right, strict=True) if ok for i in x], np.int64) for ids in (ids_a, ids_b))
        end_a, end_b, unit_end = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b]), np.cumsum(size)
        # between two neighbouring ends of either side lies exactly one link
        ends = np.union1d(end_a, end_b)
        pair = flat_b[np.searchsorted(end_b, ends)] << 32 | flat_a[np.searchsorted(end_a, ends)]
        n_links = np.bincount(np.searchsorted(unit_end, ends), minlength=len(units))
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        n_groups = np.bincount(np.searchsorted(unit_end, end_a[last_a]), minlength=len(units))
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        code = np.empty(len(flat_a) + len(flat_b), np.int64)  # a group's A tokens, then its B tokens
        code[np.arange(len(flat_a)) + np.searchsorted(group_b, group_a)] = 2 * flat_a + last_a
        code[np.arange(len(flat_b)) + np.searchsorted(group_a, group_b, "right")] = 2 * (self.a.size + flat_b) + last_b
        text, at = list(map(self.shown.__getitem__, code.tolist())), [0, *np.cumsum(n_a + n_b).tolist()]
        self.groups += ["".join(text[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        self.pairs.add(pair, n_links)
        self.right = np.concatenate([self.right, right])
        self.n = np.concatenate([self.n, [n_a, n_b, n_groups, n_links]], axis=1)

    def slice(self, texts: pa.Array) -> tuple[np.ndarray, list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text its four numbers and its groups as text, and the postings (pair, document, links) in that order."""
        self.trim()
        texts = texts.cast(pa.large_string()).fill_null("")
        slots, at = unit_slots(pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))), self.lookup, self.cut)
        fine = np.logical_and.reduceat(self.right[slots], at[:-1])
        n = np.add.reduceat(self.n[:, slots], at[:-1], axis=1) * fine
        group = self.groups.__getitem__
        shown = ["".join(map(group, slots[i:j].tolist()))[:-1] if ok else "" for i, j, ok in zip(at[:-1].tolist(), at[1:].tolist(), fine.tolist(), strict=True)]
        doc = np.repeat(np.arange(len(fine)), np.diff(at))
        use = fine[doc]
        units, times = np.unique(doc[use] * len(self.right) + slots[use], return_counts=True)
        doc, unit = np.divmod(units, len(self.right))
        pair, length = self.pairs.gather(unit)
        known, place = np.unique(pair, return_inverse=True)
        keys, links = summed(place * len(fine) + np.repeat(doc, length), np.repeat(times, length))
        return n, shown, (known[keys // len(fine)], keys % len(fine), links)


_ROW = [("b", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("a", pa.binary()), ("links", pa.binary()), ("runs", pa.binary()), ("docs", pa.binary()), ("times", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string())]
_SCHEMA = ", ".join(f"{name} {({pa.int32(): 'int', pa.int64(): 'long', pa.binary(): 'binary', pa.string(): 'string'})[kind]}" for name, kind in _ROW)


def _cut(values: np.ndarray, kind: str, at: np.ndarray) -> pa.Array:
    """A binary column: the values from one place to the next are a row."""
    data = values.astype(kind)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.record_batch([columns[name] if name in columns else pa.nulls(n, kind) for name, kind in _ROW], names=[name for name, _ in _ROW])


def _blocks(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, first: int) -> pa.RecordBatch:
    """One row a B id of the slice: its A ids with their links in all, and of each the documents with their links."""
    start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    edge = np.append(start, len(pair))
    b = pair[start] >> 32
    own = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    at = np.append(own, len(b))  # places among the distinct pairs
    held = {"b": pa.array(b[own].astype(np.int32)), "first": pa.array(np.full(len(own), first)), "n": pa.array(np.diff(edge[at]))}
    held |= {"a": _cut(pair[start] & 0xFFFFFFFF, "<u4", at), "links": _cut(np.add.reduceat(times, start), "<u8", at), "runs": _cut(np.diff(edge), "<u4", at)}
    return _batch(held | {"docs": _cut(doc, "<u2", edge[at]), "times": _cut(times, "<u4", edge[at])})


def _align(path_a: str, path_b: str, groups: bool, _held={}):  # noqa: B006 - one a worker, as it remembers
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _held:
            _held[path_a, path_b] = Aligned(vocabulary(ByteIds, path_a, True), vocabulary(PieceIds, path_b))
        aligned, row = _held[path_a, path_b], TaskContext.get().partitionId() << 40
        for batch in lines(batches, SLICE):
            n, shown, postings = aligned.slice(batch.column(1))
            digest = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown]
            rows = {"row": pa.array(row + np.arange(len(shown))), "doc_id": batch.column(0), "groups_sha256": pa.array(digest, pa.string())}
            rows |= {name: pa.array(x) for name, x in zip(("n_a", "n_b", "n_groups", "n_links"), n, strict=True)}
            yield _batch(rows | ({"groups": pa.array(shown, pa.string())} if groups else {}))
            if len(postings[0]):
                yield _blocks(*postings, row)
            row += len(shown)

    return run


def _values(column: pa.Array, kind: str, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of rows i to j - 1 of a binary column end to end, and how many each row has."""
    size = np.dtype(kind).itemsize
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset + i : column.offset + j + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if data is not None and at[-1] > at[0] else np.zeros(0, kind)
    return flat, np.diff(at) // size


def _cogroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (b, salt, kind, first, a, links, runs, docs, times) in the order of the first four: (first, docs, best, total), the shares of a slice's documents side by side.

    A group's counts (kind 0) come before its postings (kind 1), so that one pass gives each A id's links in all and their
    maximum, then each document's share. Counts are summed whenever many are gathered: at most one for each A id stays.
    """
    group, counts, waiting, size = None, None, [], 0
    out, slices, gathered = [], [], 0

    def settle():
        nonlocal waiting, size
        if waiting:
            a, links = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting, size = [summed(a, links)], 0
        return waiting[0]

    def emit():
        nonlocal out, gathered
        row, best, total = summed(*(np.concatenate(x) for x in zip(*out, strict=True)))
        firsts = np.unique(np.concatenate(slices))
        out, gathered = [], 0
        slices.clear()
        at = np.append(np.searchsorted(row, firsts), len(row))
        docs = row - np.repeat(firsts, np.diff(at))
        return pa.record_batch([pa.array(firsts), _cut(docs, "<u2", at), _cut(best, "<i8", at), _cut(total, "<i8", at)], names=["first", "docs", "best", "total"])

    for batch in batches:
        if not batch.num_rows:
            continue
        b, salt, kind = (batch.column(k).to_numpy() for k in range(3))
        edges = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])]))
        for i, j in zip(edges.tolist(), np.append(edges[1:], len(b)).tolist(), strict=True):
            if (b[i], salt[i]) != group:
                group, counts, waiting, size = (b[i], salt[i]), None, [], 0
            a, n_a = _values(batch.column(4), "<u4", i, j)
            if kind[i] == 0:
                waiting.append((a.astype(np.int64), _values(batch.column(5), "<u8", i, j)[0].astype(np.int64)))
                size += len(a)
                if size > GATHERED:
                    settle()
                continue
            if counts is None:
                known, counts = settle()
                top = counts.max()
            links = counts[np.searchsorted(known, a)]
            runs = _values(batch.column(6), "<u4", i, j)[0].astype(np.int64)
            docs, n_docs = _values(batch.column(7), "<u2", i, j)
            times = _values(batch.column(8), "<u4", i, j)[0].astype(np.int64)
            links = np.repeat(links, runs)
            first = batch.column(3).slice(i, j - i).to_numpy()
            row = np.repeat(first, n_docs) + docs
            slices.append(first)
            out.append(summed(row, np.where(links == top, times, 0), links * times))
            gathered += len(out[-1][0])
            if gathered > GATHERED:
                yield emit()
    if out:
        yield emit()


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (first, docs, best, total) in the order of first: (row, n_best, count_sum), one a document. A slice's sums are held at a time."""
    slice_, best, total = None, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    seen = np.zeros(1 << 16, bool)

    def done():
        docs = np.flatnonzero(seen)
        out = pa.record_batch([pa.array(slice_ + docs), pa.array(best[docs]), pa.array(total[docs])], names=["row", "n_best", "count_sum"])
        best[:], total[:], seen[:] = 0, 0, False
        return out

    for batch in batches:
        for i, first in enumerate(batch.column(0).to_pylist()):
            if slice_ is not None and first != slice_:
                yield done()
            slice_ = first
            docs = _values(batch.column(1), "<u2", i, i + 1)[0]
            best[docs] += _values(batch.column(2), "<i8", i, i + 1)[0]
            total[docs] += _values(batch.column(3), "<i8", i, i + 1)[0]
            seen[docs] = True
    if slice_ is not None:
        yield done()


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs, and the groups themselves if asked for.

    A text is encoded with a space before it on both sides: by a byte-level tokenizers file (A) and a sentencepiece model (B).
    Token byte ranges that overlap are links. A task aligns slices of documents and writes, for each B id of a slice, its postings:
    A ids, documents and their links. Postings are dealt by B id, sorted and read as two streams, the counts first: a group
    sums its pairs' links over the corpus and their maximum, then adds to each document its links times the count, and those
    whose count is the maximum. An id with more than HOT postings is dealt over several groups by slice, each of which gets all
    counts of the id; how many groups an id has is a table no longer than B's vocabulary. A group's task adds up the shares of
    each slice's documents, and one more shuffle brings a slice's sums together.

    Null and empty texts, and those whose bytes either side does not give back, have zeros and an empty digest, and link nothing.
    Repeated rows count as often as they come. A very long text is aligned alone, in memory of some fifty times its bytes. An empty
    table gives an empty result.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = materialise(plain.mapInArrow(_align(path_a or public_path(VOCABULARY_A), path_b or public_path(VOCABULARY_B), groups), _SCHEMA), "aligned")
    blocks = made.filter("b IS NOT NULL")
    hot = blocks.groupBy("b").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT).select("b", F.ceil(F.col("n") / HOT).cast("int").alias("groups"))
    dealt = blocks.drop("groups").join(F.broadcast(hot), "b", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    none = F.lit(None).cast("binary")
    counts = dealt.select("b", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(0).alias("kind"), "first", "a", "links", none.alias("runs"), none.alias("docs"), none.alias("times"))
    postings = dealt.select("b", F.pmod(F.xxhash64("first"), F.col("groups")).cast("int").alias("salt"), F.lit(1).alias("kind"), "first", "a", none.alias("links"), "runs", "docs", "times")
    streams = counts.unionAll(postings).repartition("b", "salt").sortWithinPartitions("b", "salt", "kind", "first")
    parts = streams.mapInArrow(_cogroup, "first long, docs binary, best binary, total binary")
    shares = parts.repartition("first").sortWithinPartitions("first").mapInArrow(_shares, "row long, n_best long, count_sum long")
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    out = made.filter("b IS NULL").select("row", *own, "groups_sha256", *(["groups"] if groups else [])).join(shares, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(*own, zero("n_best"), zero("count_sum"), "groups_sha256", *(["groups"] if groups else []))


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
