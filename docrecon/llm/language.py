"""Language identification: mixture proportions by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lines, mix64, utf8

#: n-grams of GRAM bytes are counted in SLOTS; each language's model is one row of so many numbers.
GRAM, SLOTS, HELD_OUT = 3, 1 << 14, 5
#: A mixture is settled when a step adds less than SETTLED to its log-likelihood. PENALTY is the price of one more language in log-likelihood per log of the text's n-grams.
SETTLED, PENALTY = 0.01, 6.0
#: Texts are worked on in parts of at most so many bytes; a longer text is a part alone.
PART_BYTES = 1 << 20
#: A letter is a character of Unicode category L; digits, marks and signs such as a raised 2 or a half are none.
_LETTER = regex.compile(r"\p{L}")
#: Values of lang that can be learned: a model row each. More are an error, never cut.
MAX_LANGUAGES = 1000


def _fold(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and accented Latin capitals lower-cased and ASCII without letters as spaces."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    for c in range(26):
        table[65 + c] = table[97 + c] = 97 + c
    out = table[raw]
    if len(raw) > 1:
        capital = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        out[capital] += 32
    return out


def gram_counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of slot counts for each text; n-grams cross no text border, and runs of spaces count once."""
    n = len(at) - 1
    b = _fold(raw)
    doc = np.repeat(np.arange(n), np.diff(at))
    if len(b):
        keep = np.append(True, ~((b[1:] == 32) & (b[:-1] == 32) & (doc[1:] == doc[:-1])))
        b, doc = b[keep].astype(np.uint64), doc[keep]
    if len(b) < GRAM:
        return np.zeros((n, SLOTS), np.int32)
    code = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
    same = doc[:-2] == doc[2:]
    slot = (mix64(code[same] + np.uint64(1)) % np.uint64(SLOTS)).astype(np.int64)
    return np.bincount(doc[:-2][same] * SLOTS + slot, minlength=n * SLOTS).reshape(n, SLOTS).astype(np.int32)


def _parts(batches):
    """(batch slice, bytes, offsets) of bounded size; the text is the last column."""
    for b in lines(batches, 256):
        raw, at = utf8(b.column(b.num_columns - 1))
        lo = 0
        while lo < b.num_rows:
            hi = min(b.num_rows, max(lo + 1, int(np.searchsorted(at, at[lo] + PART_BYTES, "right")) - 1))
            yield b.slice(lo, hi - lo), raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi


def held_out(id_: Column) -> Column:
    """Documents that nothing is learned from: the CRC of the id as text is divisible by five. A null id is learned from."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def fit_languages(docs: DataFrame) -> tuple[list[str], np.ndarray, int]:
    """Language names in order, the log-probability of each slot, and the place of the most frequent language, from all rows (lang, text) with a language.

    Tasks add up their texts; what meets on the driver is at most SLOTS numbers a language.
    """

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b, raw, at in _parts(batches):
            names = b.column(0).to_pylist()
            counts = gram_counts(raw, at)
            for lang in set(names):
                rows = counts[[x == lang for x in names]].sum(axis=0, dtype=np.int64)
                total[lang] = total.get(lang, 0) + rows
        for lang, row in total.items():
            slot = np.flatnonzero(row)
            yield pa.record_batch([pa.array([lang] * len(slot), pa.string()), pa.array(slot), pa.array(row[slot])], names=["lang", "slot", "n"])

    known = docs.filter("lang is not null and text is not null")
    if known.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values; it is no language column")
    table = known.select("lang", "text").mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((len(names), SLOTS))
    place = {x: i for i, x in enumerate(names)}
    counts[[place[x] for x in table.column("lang").to_pylist()], table.column("slot").to_numpy()] = table.column("n").to_numpy()
    usual = int(counts.sum(axis=1).argmax()) if names else 0
    counts += 0.5
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)), usual


def _mixture(doc: np.ndarray, starts: np.ndarray, c: np.ndarray, p: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document from its distinct n-grams (c how often, p likelihood under each
    language), and how much more any proportions can reach: the logarithm is concave, so its slope bounds the rest.

    Steps go on until the document's likelihood settles; those that have settled leave.
    """
    n = len(starts)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    likelihood, gap = np.empty(n), np.empty(n)
    total = np.add.reduceat(c, starts)
    live, before = np.arange(n), np.full(n, -np.inf)
    while len(live):
        mixed = np.einsum("ij,ij->i", share[live[doc]], p)
        now = np.add.reduceat(c * np.log(mixed), starts)
        slope = np.add.reduceat(p * (c / mixed)[:, None], starts, axis=0)
        likelihood[live], gap[live] = now, np.maximum((slope * allowed[live]).max(axis=1) - total[live], 0.0)
        on = (now - before >= SETTLED) & (gap[live] >= SETTLED)
        held = live[on]
        share[held] *= slope[on] / total[held][:, None]
        keep = on[doc]
        doc, c, p = (np.cumsum(on) - 1)[doc[keep]], c[keep], p[keep]
        starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else starts[:0]
        live, before = held, now[on]
    return share, likelihood, gap


def judge(counts: np.ndarray, logp: np.ndarray, usual: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each row of counts: the main language's place, and its share of the chosen mixture.

    The likeliest single language comes first; then the set grows by the language that, mixed with those it has, raises the
    likelihood most, up to all languages. Sets compete by likelihood less a penalty per further language. No set is likelier
    than the bound for all languages together, so a document leaves the search as soon as even that bound, less the next set's
    penalties, is no better than what it has. A row without n-grams takes the usual language with score 1 / languages.
    """
    n, languages = len(counts), len(logp)
    best, score = np.full(n, usual), np.full(n, 1.0 / languages)
    doc, slot = np.nonzero(counts)
    if not len(doc):
        return best, score
    rows, starts = np.unique(doc, return_index=True)
    c = counts[doc, slot].astype(np.float64)
    doc = np.searchsorted(rows, doc)
    logs = logp.T[slot]
    logs -= logs.max(axis=1, keepdims=True)
    p = np.maximum(np.exp(logs), 1e-300)
    _, most, gap = _mixture(doc, starts, c, p, np.ones((len(rows), languages)))
    most += gap
    price = PENALTY * np.log(np.add.reduceat(c, starts) + 1)
    single = np.add.reduceat(c[:, None] * logs, starts, axis=0)
    value = single.max(axis=1)
    best[rows], score[rows] = single.argmax(axis=1), 1.0
    held = np.zeros((len(rows), languages))
    held[np.arange(len(rows)), single.argmax(axis=1)] = 1.0
    live = np.arange(len(rows))
    for k in range(2, languages + 1):
        open_ = most[live] - (k - 1) * price[live] > value[live]
        live = live[open_]
        if not len(live):
            break
        keep = open_[doc]
        doc, c, p = (np.cumsum(open_) - 1)[doc[keep]], c[keep], p[keep]
        starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        top, pick, part = np.full(len(live), -np.inf), np.zeros(len(live), np.int64), np.zeros((len(live), languages))
        for x in range(languages):
            allowed = held[live].copy()
            new = allowed[:, x] == 0
            allowed[:, x] = 1.0
            share, likelihood, _ = _mixture(doc, starts, c, p, allowed)
            better = new & (likelihood > top)
            top[better], pick[better], part[better] = likelihood[better], x, share[better]
        held[live, pick] = 1.0
        v = top - (k - 1) * price[live]
        better = v > value[live]
        at = live[better]
        value[at] = v[better]
        best[rows[at]], score[rows[at]] = part[better].argmax(axis=1), part[better].max(axis=1)
    return best, np.clip(score, 0.0, 1.0)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs.

    Predictions use the text alone, whole, however long. A null text or one without a letter (Unicode category L) is und with
    score 0, as is every text when nothing can be learned. Repeated rows are judged alike; other columns are ignored; an empty
    table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    names, logp, usual = fit_languages(rows.filter(~F.col("held_out")))

    def run(batches):
        for b, raw, at in _parts(batches):
            letters = [t.is_valid and _LETTER.search(t.as_py()) is not None for t in b.column(2)] if names else [False] * b.num_rows
            pred, score = judge(gram_counts(raw, at), logp, usual) if names else ([0] * b.num_rows, [0.0] * b.num_rows)
            langs = [names[i] if ok else "und" for i, ok in zip(pred, letters, strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(np.where(letters, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def op10_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
