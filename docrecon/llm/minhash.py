"""Near duplicates: MinHash with tensored banding, candidates confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, lines, materialise, mix64, scratch_scope
from .graph import components

#: Each side has so many collections of SIDE_HASHES minima; every pair of a left and a right collection is a table.
#: At similarity 0.75 a pair misses all 144 tables with probability 1e-4, and 48 minima are computed where 576 would be needed.
COLLECTIONS, SIDE_HASHES = 12, 2
SHINGLE, PERCENT = 5, 75
#: Bits of the fixed-size filter (1 MB) that keeps sets of documents without candidates out of the shuffle.
FILTER_BITS = 1 << 23
#: Buckets of up to so many members join their pairs; larger ones are compared in blocks of at most CELL members a side.
SMALL_BUCKET, CELL = 32, 512
_POWER = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix64(np.arange(1, 2 * COLLECTIONS * SIDE_HASHES + 1, dtype=np.uint64) * _POWER) | np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles of a whole text; A-Z is lower-cased, a shorter text is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = mix64(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _POWER + h[i : len(h) - k + 1 + i]
    return np.unique(mix64(out))


def collection_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of the left and then the right collections: minima under multiply-shift functions, combined by SIDE_HASHES."""
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        v = hashes[None, i : i + 2048] * _SEEDS[:, None]
        v ^= v >> np.uint64(29)
        np.minimum(least, v.min(axis=1), out=least)
    keys = np.zeros(2 * COLLECTIONS, np.uint64)
    for j in range(SIDE_HASHES):
        keys = mix64(keys * _POWER + least[j::SIDE_HASHES])
    return keys.view(np.int64)


_SKETCH = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("keys", pa.list_(pa.int64()))])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in lines(batches):
        n, fp, keys = [], [], []
        for text in b.column(1):
            s = shingles(text.as_py())
            n.append(len(s))
            fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            keys.append(collection_keys(s) if len(s) else None)
        yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=_SKETCH)


def _slot(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _filter_of(ids: DataFrame) -> bytes:
    """A fixed-size bitmap of the ids' hash slots, or-ed together per word on the executors; at most FILTER_BITS / 64 rows reach the driver."""

    def slots(batches):
        for b in batches:
            bits = np.zeros(FILTER_BITS // 8, np.uint8)
            s = _slot(b.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(bits, s >> 3, (1 << (s & 7)).astype(np.uint8))
            w = bits.view(np.int64)
            at = np.flatnonzero(w)
            yield pa.record_batch([pa.array(at), pa.array(w[at])], names=["w", "bits"])

    words = ids.mapInArrow(slots, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return bits.tobytes()


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, hashes): the full sets of the documents of those ids. The fixed-size filter spares the others the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(ids))

    def sets(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for b in lines(batches):
            ids = b.column(0).cast(pa.int64()).fill_null(0)
            s = _slot(ids.to_numpy(zero_copy_only=False))
            at = np.flatnonzero((bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1)
            if len(at):
                found = [(i, shingles(b.column(1)[i].as_py())) for i in at.tolist()]
                found = [(i, s) for i, s in found if len(s)]
                yield pa.record_batch([ids.take(pa.array([i for i, _ in found], pa.int64())), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["id", "hashes"])

    return docs.mapInArrow(sets, "id long, hashes binary").join(ids, "id", "left_semi")


def _confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity."""

    def judge(batches):
        for b in batches:
            keep = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    known = materialise(_sets(docs, pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()), "sets")
    both = pairs.join(known.select(F.col("id").alias("u"), F.col("hashes").alias("x")), "u").join(known.select(F.col("id").alias("v"), F.col("hashes").alias("y")), "v")
    return both.select("u", "v", "x", "y").mapInArrow(judge, "u long, v long")


def _cell(table: pa.Table) -> pa.Table:
    """Links (u, v) between two blocks of one family: pairs that share a left and a right key, lie in different components
    and are not linked through others yet are compared on full sets."""
    side, rep = table.column("side").to_numpy(), table.column("rep").to_numpy()
    _, group = np.unique(table.column("component").to_numpy(), return_inverse=True)
    keys = np.array(table.column("keys").to_pylist(), np.int64).reshape(len(side), 2 * COLLECTIONS)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
    n = np.array([len(s) for s in sets])
    root = np.arange(int(group.max()) + 1 if len(group) else 0)

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2 stands on both
    u, v = [], []
    for i in left.tolist():
        same = keys[right] == keys[i]
        ok = same[:, :COLLECTIONS].any(axis=1) & same[:, COLLECTIONS:].any(axis=1) & (100 * np.minimum(n[right], n[i]) >= PERCENT * np.maximum(n[right], n[i]))
        ok &= (side[right] != side[i]) | (right > i)
        for j in right[ok].tolist():
            x, y = top(group[i]), top(group[j])
            if x != y and _alike(sets[i], sets[j]):
                root[x] = y
                u.append(int(rep[i]))
                v.append(int(rep[j]))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _families(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Links (u, v) within families; members has (family, rep, component, keys).

    Most of a family is one component already. Only the others are compared, with it and among themselves, in cells of two
    blocks; a member goes to as many cells as there are blocks of others, so no task holds a family whole.
    """
    sizes = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    facts = sizes.groupBy("family").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / CELL).cast("long")
    facts = facts.select("family", F.col("main.component").alias("main"), blocks(F.col("main.n")).alias("nm"), blocks(F.col("n") - F.col("main.n")).alias("nn")).filter("nn > 0")
    sets = _sets(docs, members.select(F.col("rep").alias("id")))
    full = members.join(facts, "family").join(sets.withColumnRenamed("id", "rep"), "rep")
    place = F.pmod(F.xxhash64("rep"), F.when(F.col("component") == F.col("main"), F.col("nm")).otherwise(F.col("nn")))
    full = materialise(full.withColumn("b", place), "family")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = ["rep", "component", "keys", "hashes"]
    main = full.filter("component = main").select("family", F.lit(0).alias("kind"), F.col("b").alias("i"), upto("nn").alias("j"), F.lit(0).alias("side"), *own)
    other = full.filter("component <> main")
    cross = other.select("family", F.lit(0).alias("kind"), upto("nm").alias("i"), F.col("b").alias("j"), F.lit(1).alias("side"), *own)
    among = other.withColumn("k", upto("nn")).select("family", F.lit(1).alias("kind"), F.least("b", "k").alias("i"), F.greatest("b", "k").alias("j"), F.when(F.col("b") == F.col("k"), 2).when(F.col("b") < F.col("k"), 0).otherwise(1).alias("side"), *own)
    cells = main.union(cross).union(among)
    return cells.groupBy("family", "kind", "i", "j").applyInArrow(_cell, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Rows with equal sets are one class from the start, so groups of copies cost one representative. The collections alone
    prune first: a document without a left and a right key that another one has makes no table rows. In each bucket of a
    diagonal table all members are compared with the smallest one. Buckets of any table that then still hold several
    components are finished: small ones join their pairs of different components; large ones, put together into families,
    compare what is outside a family's main component block by block. Every link is confirmed on full sets.

    A null or empty text has an empty set and links with nothing. A null doc_id is never linked: component_id and kept are
    null. Rows that repeat a doc_id share its component. An empty table gives an empty result. Other columns are ignored.
    """
    with scratch_scope() as kept:
        out = _near_duplicates(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
        kept.append(out)
    return out


def _near_duplicates(docs: DataFrame) -> DataFrame:
    """The same from rows (id, text); what it leaves in scratch is the caller's to clear."""
    sketch = materialise(docs.mapInArrow(_sketch, "id long, n long, fp binary, keys array<long>"), "sketch")
    usable = sketch.filter("n > 0 and id is not null")
    classes = materialise(usable.groupBy("fp").agg(F.min("id").alias("rep"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys")), "classes")

    # A doc_id that repeats with other words has several classes, which it links.
    again = usable.groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("id")
    links = usable.join(again, "id", "left_semi").join(classes, "fp").select(F.col("rep").alias("u"), F.col("id").alias("v"))

    single = classes.select("rep", "n", F.posexplode("keys").alias("side", "key")).select("rep", "n", "side", F.xxhash64("side", "key").alias("key"))
    seen = single.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    left = F.col("side") < COLLECTIONS
    key = F.struct("side", "key")
    sides = single.join(seen, "key", "left_semi").groupBy("rep", "n").agg(F.collect_list(F.when(left, key)).alias("a"), F.collect_list(F.when(~left, key)).alias("b"))
    tables = sides.filter("size(a) > 0 and size(b) > 0").select("rep", "n", "b", F.explode("a").alias("a")).select("rep", "n", "a", F.explode("b").alias("b"))
    tables = materialise(tables.select("rep", "n", F.xxhash64("a.key", "b.key").alias("t"), (F.col("a.side") + COLLECTIONS == F.col("b.side")).alias("diagonal")), "tables")

    own = tables.filter("diagonal")
    first = own.groupBy("t").agg(F.min(F.struct("rep", "n")).alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("t", "p")
    fits = "100 * least(n, m) >= 75 * greatest(n, m)"
    star = own.join(first, "t").select(F.col("p.rep").alias("u"), F.col("rep").alias("v"), "n", F.col("p.n").alias("m")).filter(f"u <> v and {fits}").select("u", "v").distinct()
    star = materialise(star, "star")
    with scratch_scope() as kept:
        label = components(links.union(_confirmed(docs, star)))
        kept.append(label)

    placed = tables.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", "t", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("t").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("rep").alias("head"), F.count(F.lit(1)).alias("c")).filter("lo <> hi").select("t", "head", "c")
    rest = materialise(placed.join(mixed, "t"), "rest", tables)
    small = rest.filter(F.col("c") <= SMALL_BUCKET)
    x = small.select("t", F.col("rep").alias("u"), "n", F.col("component").alias("cu"))
    y = small.select("t", F.col("rep").alias("v"), F.col("n").alias("m"), F.col("component").alias("cv"))
    more = x.join(y, "t").filter(f"u < v and cu <> cv and {fits}").select("u", "v").distinct().join(star, ["u", "v"], "left_anti")
    more = materialise(more, "more", star)
    found = _confirmed(docs, more)
    large = rest.filter(F.col("c") > SMALL_BUCKET).select(F.col("rep").alias("u"), F.col("head").alias("v"))
    if large.limit(1).count():
        family = components(large).select(F.col("node").alias("rep"), F.col("component").alias("family"))
        members = family.join(classes.select("rep", "keys"), "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left")
        members = members.select("family", "rep", F.coalesce("component", "rep").alias("component"), "keys")
        found = found.union(_families(docs, materialise(members, "members")))
    label = components(label.select(F.col("node").alias("u"), F.col("component").alias("v")).union(found))

    of_class = classes.select("fp", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    out = sketch.join(of_class, "fp", "left")
    group = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
    return materialise(out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), group.alias("component_id"), (group == F.col("id")).alias("kept")), "near-duplicates")


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is not among those of gone (one column). Rows without an id stay.

    Each id sets one of FILTER_BITS bits; their words are a table of FILTER_BITS / 64 rows at most, which is broadcast. Rows whose bit
    is not set stay where they are, and only the others, the rows of gone and few besides, meet gone in a join.
    """
    own, bits, word = F.col(f"`{id_col}`").cast("long"), free_name(docs, "bits"), free_name(docs, "word")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    mask = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), slot(c).bitwiseAND(F.lit(63)).cast("int"))
    ids = gone.select(F.col(gone.columns[0]).cast("long").alias("gone")).filter("gone is not null").distinct()
    words = ids.groupBy(F.shiftright(slot(F.col("gone")), 6).alias(word)).agg(F.bit_or(mask(F.col("gone"))).alias(bits))
    met = docs.join(F.broadcast(words), F.shiftright(slot(own), 6) == F.col(word), "left")
    open_ = F.coalesce(F.col(bits).bitwiseAND(mask(own)) != 0, F.lit(False))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    gone_id = free_name(docs, "gone")
    rest = met.filter(open_).select(*cols)
    return met.filter(~open_).select(*cols).unionAll(rest.join(ids.withColumnRenamed("gone", gone_id), own == F.col(gone_id), "left_anti").select(*cols))


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the whole documents table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
