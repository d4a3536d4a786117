"""Packing token sequences: cutting stock by column generation over the histogram of piece lengths."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lines, materialise

SEQUENCE, END_ID = 2048, 1
#: A document gives whole sequences, then one piece that is a multiple of UNIT and one below UNIT: at most SEQUENCE / UNIT + UNIT lengths.
UNIT = 64
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker remembers before it starts afresh; a bound on memory that changes no result.
REMEMBERED = 400_000


class WordIds:
    """Token ids of whole texts. Tokens never cross white space, so a word's ids are looked up once and remembered."""

    _plain = re.compile(rb"([a-z]+)?([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+)?")
    _held: dict[str, WordIds] = {}

    def __init__(self, path: str, most: int):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def at(cls, path: str | None, most: int = REMEMBERED) -> WordIds:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        path = str(path)
        if path not in cls._held:
            cls._held[path] = cls(path, most)
        cls._held[path].most = most
        return cls._held[path]

    def _word(self, w: bytes) -> bytes:
        m = self._plain.fullmatch(w)
        if m:  # letters, then marks: two tokens of the splitter, which need no normalising
            ids = [t.id for part in m.groups() if part for t in self.tokenizer.model.tokenize(part.decode())]
        else:
            ids = self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids
        out = self.known[w] = np.array(ids, "<u4").tobytes()
        return out

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers, without the end id."""
        raw = text.encode("utf-8", "replace") if text else b""
        words = raw.split() if b"<|" in raw else raw.lower().split()
        if len(self.known) > self.most:
            self.known.clear()
        known, word = self.known, self._word
        return b"".join([known.get(w) or word(w) for w in words])


def cuts(n: int, unit: int = UNIT, size: int = SEQUENCE) -> list[int]:
    """The lengths of a document's pieces in order."""
    out = [size] * (n // size)
    rest = n % size
    return out + [x for x in (rest - rest % unit, rest % unit) if x]


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, k long"


def _pieces(path: str | None, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, count = WordIds.at(path, remembered), TaskContext.get().partitionId(), np.zeros(SEQUENCE + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for b in lines(batches):
            docs, rows = b.column(0).to_pylist(), []
            for doc, text in zip(docs, b.column(1), strict=True):
                ids = words.ids(text.as_py()) + end
                n, at = len(ids) // 4, 0
                for size in cuts(n):
                    rows.append((doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n, part, int(count[size])))
                    count[size] += 1
                    at += size
            cols = list(zip(*rows, strict=True))
            types = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "k"])

    return run


def knapsack(lengths: np.ndarray, prices: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: how often each length, with a sum of at most size."""
    use = np.flatnonzero(prices > 1e-12)
    if not len(use):
        return 0.0, np.zeros(len(lengths), np.int64)
    use = use[np.argsort(lengths[use])]
    ls, ps = lengths[use], prices[use]
    best, pick = np.zeros(size + 1), np.full(size + 1, -1)
    fit = np.searchsorted(ls, np.arange(size + 1), "right")
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        if fit[c]:
            v = best[c - ls[: fit[c]]] + ps[: fit[c]]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], pick[c] = v[i], i
    pattern, c = np.zeros(len(lengths), np.int64), size
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[use[pick[c]]] += 1
            c -= int(ls[pick[c]])
    return float(best[size]), pattern


def patterns(histogram: dict[int, int], size: int = SEQUENCE, steps: int = 3000) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, {length: pieces}) that hold exactly the histogram's pieces, in few sequences.

    The linear program min sum(x), sum(pattern * x) >= counts is solved by revised simplex; its duals price lengths, and the
    knapsack's best pattern enters until none is worth more than one sequence. Whole parts of the solution are kept; what is
    left, less than one sequence a pattern, goes longest first into the first sequence with room.
    """
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0), np.int64)
    if not len(lengths):
        return []
    need = np.array([histogram[int(n)] for n in lengths], np.float64)
    m = len(lengths)
    basis = np.diag((size // lengths).astype(np.float64))
    cost = np.ones(m)
    for _ in range(steps):
        inverse = np.linalg.inv(basis)
        prices = cost @ inverse
        low = int(prices.argmin())
        if prices[low] < -1e-9:  # more pieces than asked for would be free
            enter, price = np.zeros(m), 0.0
            enter[low] = -1.0
        else:
            value, pattern = knapsack(lengths, prices, size)
            if value <= 1 + 1e-9:
                break
            enter, price = pattern.astype(np.float64), 1.0
        x, d = inverse @ need, inverse @ enter
        up = d > 1e-10
        if not up.any():
            break
        ratio = np.where(up, np.maximum(x, 0) / np.where(up, d, 1), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave], cost[leave] = enter, price
    x = np.linalg.solve(basis, need)
    left, out = need.astype(np.int64), []
    for j in np.argsort(-x, kind="stable").tolist():
        if cost[j]:
            a = basis[:, j].round().astype(np.int64)
            n = min([int(x[j] + 1e-6), *(left[a > 0] // a[a > 0]).tolist()])
            if n > 0:
                left -= n * a
                out.append((n, {int(lengths[i]): int(a[i]) for i in np.flatnonzero(a)}))
    bins: list[tuple[int, dict[int, int]]] = []
    for i in range(m - 1, -1, -1):
        for _ in range(int(left[i])):
            n = int(lengths[i])
            at = next((k for k, (free, _) in enumerate(bins) if free >= n), None)
            if at is None:
                bins.append((size - n, {n: 1}))
            else:
                free, held = bins[at]
                held[n] = held.get(n, 0) + 1
                bins[at] = (free - n, held)
    return out + [(1, held) for _, held in bins]


def slots(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, lo, hi, first, each, offset): pieces of a length that rank from lo to hi - 1 fill, each at a time, the sequences from first on, side by side from the offset."""
    rows, used, first = [], {}, 0
    for n, held in plan:
        offset = 0
        for length in sorted(held, reverse=True):
            lo = used.get(length, 0)
            used[length] = lo + n * held[length]
            rows.append((length, lo, used[length], first, held[length], offset))
            offset += length * held[length]
        first += n
    return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all rows of docs in sequences of at most SEQUENCE tokens.

    Texts are tokenised once; only lengths and checksums move after that. The histogram (at most SEQUENCE / UNIT + UNIT
    lengths) is solved on the driver; each piece finds its place by its rank among the pieces of its length, from counts by
    task and a counter within the task. A null or empty text is the end id alone. Repeated rows are packed as often as they
    come. An empty table gives no rows. vocabulary is a path; by default that of the installed public file. A worker remembers the ids of so many words.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialise(plain.mapInArrow(_pieces(vocabulary, remembered), _PIECES), "pieces")
    counts = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = slots(patterns(histogram))
    table = spark.createDataFrame(rows, "len long, lo long, hi long, first long, each long, at long")
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("part", "length", before.alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("k"))
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("at") + nth % F.col("each") * F.col("length")).alias("offset"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """The whole documents table, packed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
