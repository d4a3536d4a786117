"""Duplicate passages: suffixes sorted by the deep-shallow method, bytes of repeated 50-byte strings removed.

Sorting every suffix of a corpus in one place does not scale, so work is dealt by content first. Among the GRAM-byte strings
of each 50-byte window the one of least hash is its anchor; equal windows have equal anchors at equal places, so dealing by
the anchor's hash brings equal windows together. Anchors that a single document has are dropped before any text moves. The
regions around the others go to their hash's bucket, where their suffixes are sorted and runs that agree in 50 bytes show
which documents share a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, mix64, utf8

LENGTH, GRAM = 50, 20
#: Documents are dealt in chunks of about so many bytes of text (a longer document is a chunk alone).
CHUNK_BYTES = 2 << 20
#: Text that a bucket of anchors stands for, and text of the chunks of one task: the number of either follows the data.
BUCKET_BYTES, TASK_BYTES = 20 << 20, 40 << 20
#: Depth of the multikey quicksort, in bytes; groups that still agree go to blind tries.
SHALLOW = 24
#: Windows of a bucket that are sorted at once; bytes of a chunk whose anchors are looked for at once.
SORTED_WINDOWS, BLOCK = 1 << 18, 1 << 18
_SPAN = LENGTH - GRAM + 1
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD6E8FEB86659FD93)


# --- the suffix sort ---------------------------------------------------------------------------------------------------


def _digits(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number that orders as they do."""
    return buf[at[:, None] + np.arange(8)].copy().view(">u8").ravel().astype(np.uint64)


def multikey_quicksort(buf: np.ndarray, at: np.ndarray, depth: int, small: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of their first depth bytes, and where each group of equal ones begins.

    Letters are eight bytes wide. Parts split three ways at a pivot letter; the equal part moves on to the next letter.
    Small parts are ordered on their remaining letters at once. buf must reach depth bytes beyond every suffix.
    """
    out, heads = [], []
    stack = [(at, 0)]
    while stack:
        part, d = stack.pop()
        if d >= depth or len(part) < 2:
            out.append(part)
            heads.append(np.arange(len(part)) == 0)
            continue
        if len(part) <= small:
            keys = [_digits(buf, part + i) for i in range(d, depth, 8)]
            order = np.lexsort(keys[::-1])
            new = np.zeros(len(part), bool)
            new[0] = True
            for k in keys:
                k = k[order]
                new[1:] |= k[1:] != k[:-1]
            out.append(part[order])
            heads.append(new)
            continue
        k = _digits(buf, part + d)
        pivot = np.partition(k[:: max(1, len(k) // 255)], min(127, len(k[:: max(1, len(k) // 255)]) // 2))[min(127, len(k[:: max(1, len(k) // 255)]) // 2)]
        for sub, deeper in ((part[k > pivot], d), (part[k == pivot], d + 8), (part[k < pivot], d)):  # the last is taken first
            if len(sub):
                stack.append((sub, deeper))
    return (np.concatenate(out), np.flatnonzero(np.concatenate(heads))) if out else (at, np.zeros(0, np.int64))


class BlindTrie:
    """Strings of one length by the bytes where they branch only; a search compares those, then one whole string."""

    def __init__(self, first: bytes):
        self.strings, self.root = [first], 0  # a node is a leaf number or [depth, {byte: node}]

    def add(self, s: bytes) -> int:
        """The number of the leaf of s, new or found."""
        node = self.root
        while not isinstance(node, int):
            depth, kids = node
            node = kids[s[depth]] if s[depth] in kids else next(iter(kids.values()))
        t = self.strings[node]
        if s == t:
            return node
        lcp = next(i for i, (x, y) in enumerate(zip(s, t, strict=True)) if x != y)
        leaf = len(self.strings)
        self.strings.append(s)
        parent, edge, node = None, None, self.root
        while not isinstance(node, int) and node[0] < lcp:
            parent, edge, node = node, s[node[0]], node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == lcp:
            node[1][s[lcp]] = leaf
        else:
            fork = [lcp, {t[lcp]: node, s[lcp]: leaf}]
            if parent is None:
                self.root = fork
            else:
                parent[1][edge] = fork
        return leaf

    def order(self) -> list[int]:
        """The leaves in the order of their strings."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack.extend(kid for _, kid in sorted(node[1].items(), key=lambda x: -x[0]))
        return out


def deep_shallow(buf: np.ndarray, at: np.ndarray, depth: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at those places in the order of their first depth bytes, and where runs that agree in all of them begin.

    Multikey quicksort to the shallow depth; a group whose rest is the same throughout is done (one comparison of whole
    columns tells), any other is ordered by a blind trie of its rests. buf must reach depth + 8 bytes beyond every suffix.
    """
    order, heads = multikey_quicksort(buf, at, shallow)
    ends = np.append(heads[1:], len(order))
    new = np.zeros(len(order), bool)
    new[heads] = True
    if depth <= shallow or not len(order):
        return order, heads
    mixed = np.zeros(len(heads), bool)
    group = np.cumsum(new) - 1
    for i in range(0, len(order), 1 << 16):  # against the one before, within a group
        x = order[max(0, i - 1) : i + (1 << 16)]
        rest = buf[x[:, None] + np.arange(shallow, depth)]
        g = group[max(0, i - 1) : i + (1 << 16)]
        differ = (rest[1:] != rest[:-1]).any(axis=1) & (g[1:] == g[:-1])
        mixed[g[1:][differ]] = True
    raw = buf.tobytes() if mixed.any() else b""
    for g in np.flatnonzero(mixed).tolist():
        lo, hi = heads[g], ends[g]
        part = order[lo:hi].tolist()
        trie, leaf = None, []
        for p in part:
            s = raw[p + shallow : p + depth]
            if trie is None:
                trie = BlindTrie(s)
                leaf.append(0)
            else:
                leaf.append(trie.add(s))
        rank = np.empty(len(trie.strings), np.int64)
        rank[trie.order()] = np.arange(len(trie.strings))
        r = rank[leaf]
        o = np.argsort(r, kind="stable")
        order[lo:hi] = order[lo:hi][o]
        new[lo + 1 : hi] = r[o][1:] != r[o][:-1]
    return order, np.flatnonzero(new)


# --- chunks of documents -----------------------------------------------------------------------------------------------


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blob) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(blob)) as r:
        return r.read_next_batch()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, bytes of text, blob); the last two columns of a batch are the document's id and text."""
    part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

    def done():
        table = pa.Table.from_batches(held).combine_chunks()
        return pa.record_batch([pa.array([(part << 32) + n], pa.int64()), pa.array([size], pa.int64()), pa.array([_pack(table.to_batches()[0])], pa.binary())], names=["chunk", "size", "blob"])

    for b in batches:
        b = b.set_column(b.num_columns - 1, "t", b.column(b.num_columns - 1).cast(pa.large_string()))
        _, at = utf8(b.column(b.num_columns - 1))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK_BYTES - size, "right")) - 1)
            if hi == lo + 1 and held and size + at[hi] - at[lo] > CHUNK_BYTES:
                yield done()
                n, held, size = n + 1, [], 0
                continue
            hi = min(hi, b.num_rows)
            held.append(b.slice(lo, hi - lo))
            size += int(at[hi] - at[lo])
            lo = hi
    if held:
        yield done()


def _least(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the grams of buf, and for each window the place of the one of least hash."""
    h = _LETTER[buf]
    two = h[:-1] * _STEP + h[1:]
    del h
    four = two[:-2] * _STEP + two[2:]
    del two
    eight = four[:-4] * _STEP + four[4:]
    sixteen = eight[:-8] * _STEP + eight[8:]
    del eight
    gram = mix64(sixteen[:-4] * _STEP + four[16:])
    del four, sixteen
    value, place = gram, np.arange(len(gram), dtype=np.int32)
    width = 1
    while width < _SPAN:
        by = min(width, _SPAN - width)
        less = value[by:] < value[:-by]
        value = np.where(less, value[by:], value[:-by])
        place = np.where(less, place[by:], place[:-by])
        width += by
    return gram, place


class Chunk:
    """The anchors of a chunk's windows: for the i-th, hashes[i] at place p[i] serves windows lo[i] to hi[i] of document doc[i]."""

    def __init__(self, blob):
        self.batch = _unpack(blob)
        self.buf, self.at = utf8(self.batch.column(self.batch.num_columns - 1))
        ids = self.batch.column(self.batch.num_columns - 2).cast(pa.int64())
        self.ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        n = len(self.buf)
        sizes = np.diff(self.at)
        valid = np.zeros(n + 1, np.int8)
        full = sizes >= LENGTH
        np.add.at(valid, self.at[:-1][full], 1)
        np.add.at(valid, self.at[1:][full] - LENGTH + 1, -1)
        starts = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8))
        p, lo, hashes, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], -1
        for a in range(0, n - LENGTH + 1, BLOCK):
            own = starts[np.searchsorted(starts, a) : np.searchsorted(starts, a + BLOCK)]
            if len(own):
                gram, place = _least(self.buf[a : a + BLOCK + LENGTH - 1])
                q = place[own - a].astype(np.int64)
                new = np.diff(q, prepend=last - a) != 0
                last = int(q[-1]) + a
                p.append(q[new] + a)
                lo.append(own[new])
                hashes.append(gram[q[new]])
        self.p, self.lo, self.hashes = np.concatenate(p), np.concatenate(lo), np.concatenate(hashes)
        self.hi = starts[np.append(np.searchsorted(starts, self.lo)[1:], len(starts)) - 1] if len(starts) else self.lo
        self.doc = np.searchsorted(self.at, self.p, "right") - 1

    def region(self, i: int) -> bytes:
        return self.buf[self.lo[i] : self.hi[i] + LENGTH].tobytes()

    def alike(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Within the chunk: the hash order of anchors; the anchor that stands for each (of the same hash, region and place, the
        first of least doc_id); whether each is settled, as one of the same region has a smaller doc_id."""
        n = len(self.hashes)
        order = np.argsort(self.hashes, kind="stable")
        stands, settled = np.arange(n), np.zeros(n, bool)
        s = self.hashes[order]
        heads = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if n else np.zeros(0, np.int64)
        ends = np.append(heads[1:], n)
        for lo, hi in zip(heads[ends - heads > 1].tolist(), ends[ends - heads > 1].tolist(), strict=True):
            least: dict = {}
            members = order[lo:hi].tolist()
            keys = [(self.p[i] - self.lo[i], xxhash.xxh3_128_digest(self.region(i))) for i in members]
            for i, k in zip(members, keys, strict=True):
                if k not in least or self.ids[self.doc[i]] < self.ids[self.doc[least[k]]]:
                    least[k] = i
            for i, k in zip(members, keys, strict=True):
                stands[i] = least[k]
                settled[i] = self.ids[self.doc[i]] > self.ids[self.doc[least[k]]]
        return order, stands, settled


def _by_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _short(hashes: np.ndarray) -> np.ndarray:
    """What is sent of a hash within its bucket, 32 bits; two hashes that agree there only cost a region that is compared in vain."""
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _seen(buckets: int):
    """Chunks to rows (bucket, chunk, hashes, often): each anchor hash of a chunk once, and whether several documents have it there."""

    def run(batches):
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = Chunk(blob.as_buffer())
                if not len(c.hashes):
                    continue
                order = np.argsort(c.hashes, kind="stable")
                h, d = c.hashes[order], c.doc[order]
                heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                often = np.maximum.reduceat(d, heads) != np.minimum.reduceat(d, heads)
                h = h[heads]
                bucket = _by_bucket(h, buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                h, often = _short(h[order]), often[order]
                used = np.flatnonzero(np.diff(cuts))
                cols = [pa.array(used), pa.array(np.full(len(used), chunk)), pa.array([h[cuts[i] : cuts[i + 1]].tobytes() for i in used], pa.binary()), pa.array([np.packbits(often[cuts[i] : cuts[i + 1]]).tobytes() for i in used], pa.binary())]
                yield pa.record_batch(cols, names=["bucket", "chunk", "hashes", "often"])

    return run


def _shared(table: pa.Table) -> pa.Table:
    """For one bucket: rows (chunk, bucket, hashes) of what several documents have."""
    each = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("hashes")]
    sizes = [len(x) for x in each]
    h = np.concatenate(each)
    often = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n) for x, n in zip(table.column("often"), sizes, strict=True)]).astype(bool)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(h, kind="stable")
    s = h[order]
    heads = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    counts = np.diff(np.append(heads, len(s)))
    keep = np.repeat((counts > 1) | np.logical_or.reduceat(often[order], heads), counts)
    kept, of = s[keep], owner[order][keep]
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(len(sizes) + 1))
    kept = kept[order]
    used = np.flatnonzero(np.diff(cuts))
    chunks = table.column("chunk").to_numpy()
    return pa.table({"chunk": pa.array(chunks[used], pa.int64()), "bucket": pa.array(table.column("bucket").to_numpy()[used], pa.int64()), "hashes": pa.array([kept[cuts[i] : cuts[i + 1]].tobytes() for i in used], pa.binary())})


_REGION = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("anchor", "<i4"), ("place", "<i2"), ("size", "<i2")])


def _regions(buckets: int):
    """A chunk and the anchor hashes it shares to rows (bucket, chunk, heads, bytes): the regions that stand for others."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = {"bucket": [], "chunk": [], "heads": [], "bytes": []}
        if left.num_rows and right.num_rows:
            c = Chunk(left.column("blob")[0].as_buffer())
            shared = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) + (np.uint64(b) << np.uint64(32)) for b, x in zip(right.column("bucket").to_pylist(), right.column("hashes"), strict=True)]))
            _, stands, _ = c.alike()
            keys = _short(c.hashes) + (_by_bucket(c.hashes, buckets).astype(np.uint64) << np.uint64(32))
            at = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
            mine = np.flatnonzero((shared[at] == keys) & (stands == np.arange(len(stands))))
            bucket = _by_bucket(c.hashes[mine], buckets)
            order = np.argsort(bucket, kind="stable")
            mine, bucket = mine[order], bucket[order]
            heads = np.zeros(len(mine), _REGION)
            heads["hash"], heads["doc"], heads["anchor"], heads["place"], heads["size"] = c.hashes[mine], c.ids[c.doc[mine]], mine, c.p[mine] - c.lo[mine], c.hi[mine] - c.lo[mine] + LENGTH
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            raw, squeeze = c.buf.tobytes(), zstandard.ZstdCompressor(level=3).compress
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                part = mine[cuts[b] : cuts[b + 1]]
                cols["bucket"].append(b)
                cols["chunk"].append(left.column("chunk")[0].as_py())
                cols["heads"].append(squeeze(heads[cuts[b] : cuts[b + 1]].tobytes()))
                cols["bytes"].append(squeeze(b"".join([raw[x:y] for x, y in zip(c.lo[part].tolist(), (c.hi[part] + LENGTH).tolist(), strict=True)])))
        return pa.table({"bucket": pa.array(cols["bucket"], pa.int64()), "chunk": pa.array(cols["chunk"], pa.int64()), "heads": pa.array(cols["heads"], pa.binary()), "bytes": pa.array(cols["bytes"], pa.binary())})

    return run


_FOUND = np.dtype([("anchor", "<i4"), ("lo", "<i2"), ("hi", "<i2")])


def _elsewhere(buf: np.ndarray, begin: np.ndarray, place: np.ndarray, windows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each region a bit a window, set where an equal window has a smaller document.

    Equal windows hold their anchor at the same distance from their start: where an anchor has many regions, windows are sorted
    by some distances at a time, so that at most SORTED_WINDOWS, or one for each region, are sorted at once.
    """
    bits, step = np.zeros(len(begin), np.uint32), int(max(1, _SPAN * SORTED_WINDOWS // max(1, int(windows.sum()))))
    for v in range(0, _SPAN, step):
        lo, hi = np.maximum(place - v - step + 1, 0), np.minimum(place - v, windows - 1)
        n = np.maximum(hi - lo + 1, 0)
        region = np.repeat(np.arange(len(begin)), n)
        if not len(region):
            continue
        inside = lo[region] + np.arange(len(region)) - np.repeat(np.cumsum(n) - n, n)
        at = begin[region] + inside  # in order, as regions lie one behind another
        order, runs = deep_shallow(buf, at)
        back = np.searchsorted(at, order)
        doc = least[region[back]]
        hit = back[doc > np.repeat(np.minimum.reduceat(doc, runs), np.diff(np.append(runs, len(order))))]
        np.bitwise_or.at(bits, region[hit], np.uint32(1) << inside[hit].astype(np.uint32))
    return bits


def _found(raw: memoryview, heads: np.ndarray, begin: np.ndarray, ends: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the heads in part, all of some anchors in hash order: heads, first and last windows of what starts in a smaller document too."""
    # the same region under the same anchor counts once, with the least document
    own = heads[part]
    same = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(begin[part].tolist(), ends[part].tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    order = np.lexsort((same[:, 1], same[:, 0], own["place"], own["hash"]))
    new = np.ones(len(order), bool)
    new[1:] = (same[order[1:]] != same[order[:-1]]).any(axis=1) | (own["place"][order[1:]] != own["place"][order[:-1]]) | (own["hash"][order[1:]] != own["hash"][order[:-1]])
    one = np.empty(len(order), np.int64)
    one[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(own["doc"][order], np.flatnonzero(new))
    later = own["doc"] > least[one]
    # suffixes of the regions of anchors that have several
    sample = order[new]
    h = own["hash"][sample]
    several = np.append(False, h[1:] == h[:-1]) | np.append(h[1:] == h[:-1], False)
    texts = sample[several]
    size = own["size"][texts].astype(np.int64)
    buf = np.frombuffer(b"".join([raw[x:y] for x, y in zip(begin[part[texts]].tolist(), ends[part[texts]].tolist(), strict=True)]) + bytes(LENGTH + 8), np.uint8)
    bits = np.zeros(len(sample), np.uint32)
    bits[several] = _elsewhere(buf, np.cumsum(size) - size, own["place"][texts].astype(np.int64), size - LENGTH + 1, least[several])
    # a region of a later document goes whole, of one of the least the ranges of windows
    mine = np.flatnonzero(~later & (bits[one] != 0))
    b = bits[one[mine]]
    edge = lambda x: np.nonzero(np.unpackbits(x.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little"))
    (which, lo), (_, hi) = edge(b & ~(b << np.uint32(1))), edge(b & ~(b >> np.uint32(1)))
    whole = part[later]
    return np.append(whole, part[mine[which]]), np.append(np.zeros(len(whole), np.int64), lo), np.append(heads["size"][whole].astype(np.int64) - LENGTH, hi)


def _sorted_bucket(table: pa.Table) -> pa.Table:
    """For one bucket: rows (chunk, found) with the windows lo to hi (after the region's first) of an anchor that start in a smaller document too."""
    expand = zstandard.ZstdDecompressor().decompress
    each = [np.frombuffer(expand(x.as_buffer()), _REGION) for x in table.column("heads")]
    counts, heads = [len(x) for x in each], np.concatenate(each)
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(heads["size"].astype(np.int64))
    begin = ends - heads["size"]
    raw, at = memoryview(bytearray(int(ends[-1]))), 0
    for x in table.column("bytes"):
        text = expand(x.as_buffer())
        raw[at : at + len(text)] = text
        at += len(text)
    # anchors are worked on some at a time, as no window is equal under another one; of each: head, first and last window of what is found
    order = np.argsort(heads["hash"], kind="stable")
    s = heads["hash"][order]
    firsts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    windows = np.cumsum(np.add.reduceat(heads["size"][order].astype(np.int64) - LENGTH + 1, firsts))
    cuts = firsts[np.flatnonzero(np.diff(windows // SORTED_WINDOWS, prepend=-1))]
    parts = [_found(raw, heads, begin, ends, order[x:y]) for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True)]
    of, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    found = np.zeros(len(of), _FOUND)
    found["anchor"], found["lo"], found["hi"] = heads["anchor"][of], lo, hi
    whose = owner[of]
    order = np.argsort(whose, kind="stable")
    cuts = np.searchsorted(whose[order], np.arange(len(counts) + 1))
    found = found[order]
    used = np.flatnonzero(np.diff(cuts))
    chunks = table.column("chunk").to_numpy()
    return pa.table({"chunk": pa.array(chunks[used], pa.int64()), "found": pa.array([found[cuts[i] : cuts[i + 1]].tobytes() for i in used], pa.binary())})


def _removed(c: Chunk, found: np.ndarray) -> np.ndarray:
    """Which bytes of the chunk go."""
    n = len(c.buf)
    edge = np.zeros(n + 1, np.int32)
    if len(c.hashes):
        _, stands, settled = c.alike()
        lo, hi = [c.lo[settled]], [c.hi[settled]]
        if len(found):
            found = found[np.argsort(found["anchor"], kind="stable")]
            followers = np.flatnonzero(~settled)  # an anchor shares what is found of the one that stands for it
            x = np.searchsorted(found["anchor"], stands[followers], "left")
            m = np.searchsorted(found["anchor"], stands[followers], "right") - x
            pick = np.repeat(x, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            base = np.repeat(c.lo[followers], m)
            lo.append(base + found["lo"][pick])
            hi.append(base + found["hi"][pick])
        np.add.at(edge, np.concatenate(lo), 1)
        np.add.at(edge, np.concatenate(hi) + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def _found_of(right: pa.Table) -> np.ndarray:
    return np.concatenate([np.zeros(0, _FOUND), *(np.frombuffer(x.as_buffer(), _FOUND) for x in right.column("found"))])


def _digest(left: pa.Table, right: pa.Table) -> pa.Table:
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    rows: list[tuple] = []
    if left.num_rows:
        c = Chunk(left.column("blob")[0].as_buffer())
        gone = _removed(c, _found_of(right))
        for doc, x, y in zip(c.batch.column(c.batch.num_columns - 2).to_pylist(), c.at[:-1].tolist(), c.at[1:].tolist(), strict=True):
            g = gone[x:y]
            spans = int(np.count_nonzero(np.diff(g.view(np.int8), prepend=np.int8(0)) == 1))
            rows.append((doc, y - x, int(g.sum()), spans, hashlib.sha256(c.buf[x:y][~g].tobytes()).hexdigest()))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.table({k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in zip(names, columns, strict=True)})


def _rewrite(schema: pa.Schema, text_at: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        c = Chunk(left.column("blob")[0].as_buffer())
        gone = _removed(c, _found_of(right))
        old = c.batch.column(c.batch.num_columns - 1)
        texts = [None if not old[i].is_valid else c.buf[x:y][~gone[x:y]].tobytes().decode("utf-8", "ignore") for i, (x, y) in enumerate(zip(c.at[:-1].tolist(), c.at[1:].tolist(), strict=True))]
        columns = [c.batch.column(i) for i in range(c.batch.num_columns - 2)]
        columns[text_at] = pa.array(texts, pa.string())
        return pa.table([x.cast(f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _solved(docs: DataFrame):
    """(chunk, size, blob) and (chunk, found), both grouped by chunk, for docs whose last two columns are the id and the text.

    Buckets and tasks follow the bytes of text. What each step shuffles goes before the next begins; the chunks and the
    findings stay for the caller. A hot anchor costs its bucket, for each chunk that has it, every different region once, of 80 bytes
    at most; what sorting adds to these is bounded by SORTED_WINDOWS, or one window a region.
    """
    spark = docs.sparkSession
    chunks = materialise(docs.mapInArrow(_chunks, "chunk long, size long, blob binary"), "chunks")
    size = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    seen = chunks.select("chunk", "blob").mapInArrow(_seen(buckets), "bucket long, chunk long, hashes binary, often binary")
    shared = materialise(seen.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_shared, "chunk long, bucket long, hashes binary"), "shared")

    def by_chunk(df):
        return df.repartition(tasks, "chunk").groupBy("chunk")

    regions = by_chunk(chunks.select("chunk", "blob")).cogroup(by_chunk(shared)).applyInArrow(_regions(buckets), "bucket long, chunk long, heads binary, bytes binary")
    found = materialise(regions.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_sorted_bucket, "chunk long, found binary"), "found", shared)
    return by_chunk(chunks), by_chunk(found)


def passage_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs.

    A byte is removed if a 50-byte string that covers it also starts in a document of smaller doc_id. A null or empty text has
    no bytes. A null doc_id counts as the largest. Rows that share a doc_id do not remove each other. Empty tables give no rows.
    """
    two = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    chunks, found = _solved(two)
    return chunks.cogroup(found).applyInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of docs, whatever they are called, with repeated passages cut from the text (a character cut in half goes whole); null stays null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    own = [F.col(f"`{c}`") for c in docs.columns]
    i, t = free_name(docs, "passage_id"), free_name(docs, "passage_text")
    chunks, found = _solved(docs.select(*own, F.col(f"`{id_col}`").cast("long").alias(i), F.col(f"`{text_col}`").cast("string").alias(t)))
    schema = to_arrow_schema(docs.schema)
    return chunks.cogroup(found).applyInArrow(_rewrite(schema, docs.columns.index(text_col)), docs.schema)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of the whole documents table."""
    return passage_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
