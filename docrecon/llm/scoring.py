"""Language-model scores: masked pseudo-likelihood of a bidirectional window network, trained in numpy."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lines, materialise

#: Words are counted in 2**BITS hash slots; the vocabulary then takes the least power of two of slots that is SPARE times the slots in use.
BITS, LEAST_BITS, SPARE = 22, 14, 4
#: Output words form groups of LEAVES: the commonest words are leaves of their own, the first leaf of a group is its share of
#: the rarer words. Groups grow with the root of the vocabulary.
LEAVES, LEAST_GROUPS, MOST_GROUPS = 64, 8, 256
#: Words on each side, hidden units, tokens a training step, and the rate of the adaptive steps.
SIDE, HIDDEN, STEP_TOKENS, RATE = 2, 16, 16_384, 0.1
#: Tokens of a training shard. Round r trains on the tokens whose place leaves r, so that all rounds together cover every token once.
SHARD_TOKENS, ROUNDS = 2_000_000, 2
BLOCK = 32_768
#: Rows of outputs that are worked on at once, so that they stay in a core's cache.
WIDE = 1024
#: Parameters of shards are added up as whole numbers of 1 / SCALE, so that their mean does not depend on the order.
SCALE = 1 << 24
#: Equal rows (doc_id and text) that a task deals to one shard before it takes the next.
LOT = 256


def slots_of(text: str | None, bits: int = BITS) -> np.ndarray:
    """The slot of each word of a whole text; A-Z is lower-cased."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    return np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, len(words)) & ((1 << bits) - 1)


class Vocabulary:
    """Leaf and share of each slot, from the corpus counts of slots."""

    def __init__(self, counts: np.ndarray):
        used = int(np.count_nonzero(counts))
        self.bits = LEAST_BITS
        while self.bits < BITS and 1 << self.bits < SPARE * used:
            self.bits += 1
        counts = counts.reshape(-1, 1 << self.bits).sum(axis=0)  # lower bits of a slot are its slot of fewer bits
        self.groups = LEAST_GROUPS
        while self.groups < MOST_GROUPS and (16 * self.groups) ** 2 < used:
            self.groups *= 2
        order = np.argsort(-counts, kind="stable")[: self.groups * (LEAVES - 1)]
        order = order[counts[order] > 0]
        slots = np.arange(1 << self.bits)
        leaf = slots % self.groups * LEAVES  # the first leaf of a group
        rank = np.arange(len(order))
        leaf[order] = rank % self.groups * LEAVES + 1 + rank // self.groups
        self.leaf = leaf.astype(np.uint16)
        whole = np.bincount(leaf, counts, self.groups * LEAVES)
        self.share = np.log(np.maximum(counts, 0.5) / np.maximum(whole[leaf], 0.5)).astype(np.float32)  # 0 for a word with a leaf of its own
        self.whole = whole


class Window:
    """tanh of the sum of the neighbours' vectors by place; a softmax over groups, then one over the leaves of the word's group."""

    def __init__(self, groups: int, flat: np.ndarray | None = None, whole: np.ndarray | None = None):
        self.groups = groups
        shapes = [(2 * SIDE, groups * LEAVES + 1, HIDDEN), (HIDDEN, groups), (groups,), (groups, HIDDEN, LEAVES), (groups, LEAVES)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        if flat is None:
            rng = np.random.default_rng(11)
            whole = np.ones(groups * LEAVES) if whole is None else whole + 1.0
            by_group = whole.reshape(groups, LEAVES).sum(axis=1)
            leaf = np.log(whole.reshape(groups, LEAVES) / by_group[:, None])
            flat = np.concatenate([rng.normal(0, 0.3, ends[0]), rng.normal(0, 0.1, ends[1] - ends[0]), np.log(by_group / by_group.sum()), rng.normal(0, 0.1, ends[3] - ends[2]), leaf.ravel()])
        self.flat = flat.astype(np.float32).copy()
        self.near, self.top, self.top_bias, self.leaf, self.leaf_bias = (x.reshape(s) for x, s in zip(np.split(self.flat, ends[:-1]), shapes, strict=True))

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.near[0].take(around[:, 0], axis=0)
        for j in range(1, 2 * SIDE):
            h += self.near[j].take(around[:, j], axis=0)
        return np.tanh(h, out=h)

    @staticmethod
    def _exp(z: np.ndarray, reach: float) -> np.ndarray:
        """The exponentials of z in place. Hidden units lie in -1 to 1, so that reach bounds z; values far beyond what is learned are clipped, which is safe in single precision."""
        if not reach < 60:
            np.clip(z, -60, 60, out=z)
        return np.exp(z, out=z)

    def _chance(self, z: np.ndarray, pick: np.ndarray, reach: float) -> np.ndarray:
        """The softmax at one place of each row."""
        self._exp(z, reach)
        return z[np.arange(len(z)), pick] / (z @ np.ones(z.shape[1], z.dtype))

    def _reach(self) -> tuple[float, np.ndarray]:
        """Bounds of the outputs of the groups, and of the leaves of each group."""
        top = np.abs(self.top).sum(axis=0).max() + np.abs(self.top_bias).max()
        return float(top), np.abs(self.leaf).sum(axis=1).max(axis=1) + np.abs(self.leaf_bias).max(axis=1)

    @staticmethod
    def _sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of small numbers, the distinct ones, and where each begins in that order."""
        order = np.argsort(values.astype(np.uint16), kind="stable")
        s = values[order]
        heads = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        return order, s[heads], heads

    def _by_leaf(self, around: np.ndarray, centre: np.ndarray):
        """Tokens in the order of their leaves: that order, the neighbours and leaves in it, the distinct leaves, where each begins, and
        parts of whole groups with WIDE rows or more, each as (slice, [(group, slice) of its groups])."""
        order, used, heads = self._sorted(centre)
        first = np.flatnonzero(np.append(True, used[1:] // LEAVES != used[:-1] // LEAVES))
        at, parts, runs, begin = [*heads[first].tolist(), len(order)], [], [], 0
        for k, g in enumerate((used[first] // LEAVES).tolist()):
            runs.append((g, slice(at[k], at[k + 1])))
            if at[k + 1] - begin >= WIDE or at[k + 1] == len(order):
                parts.append((slice(begin, at[k + 1]), runs))
                runs, begin = [], at[k + 1]
        return order, around.take(order, axis=0), centre.take(order), used.astype(np.int64), heads, parts

    def _joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of the groups and of their leaves, with the bias as the weight of a last hidden unit that is always 1."""
        return np.concatenate([self.top, self.top_bias[None]]), np.concatenate([self.leaf, self.leaf_bias[:, None]], axis=1)

    def _hidden_and_one(self, around: np.ndarray) -> np.ndarray:
        h = np.ones((len(around), HIDDEN + 1), np.float32)
        h[:, :HIDDEN] = self.hidden(around)
        return h

    def log_probability(self, around: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """The log-probability of each centre leaf given its neighbours."""
        order, around, centre, _, _, parts = self._by_leaf(around, centre)
        h, (top, leaf), (reach, reaches) = self._hidden_and_one(around), self._joined(), self._reach()
        group, within, p = centre // LEAVES, centre % LEAVES, np.empty(len(centre), np.float32)
        for i in range(0, len(p), WIDE):
            p[i : i + WIDE] = self._chance(h[i : i + WIDE] @ top, group[i : i + WIDE], reach)
        for part, runs in parts:
            z = np.empty((part.stop - part.start, LEAVES), np.float32)
            for g, at in runs:
                np.matmul(h[at], leaf[g], out=z[at.start - part.start : at.stop - part.start])
            p[part] *= self._chance(z, within[part], max(reaches[g] for g, _ in runs))
        out = np.empty_like(p)
        out[order] = np.log(np.maximum(p, 1e-30))
        return out

    def learn(self, around: np.ndarray, centre: np.ndarray, square: Window) -> None:
        """One adaptive gradient step; square holds the running sums of squared gradients in a network's shape.

        The gradient of a softmax is its probabilities less 1 at the own word. Both parts are summed apart, so that a row's outputs
        are only raised, summed and multiplied: exponentials by weights with a last column of ones give the row's sum as well.
        """
        n = len(centre)
        _, around, centre, used, heads, parts = self._by_leaf(around, centre)
        h, (top, leaf), (reach, reaches) = self._hidden_and_one(around), self._joined(), self._reach()

        def step(value, seen, gradient):
            seen += gradient * gradient
            value -= RATE * gradient / (np.sqrt(seen) + 1e-6)

        def with_ones(weights):
            out = np.ones((*weights.shape[:-2], weights.shape[-1], HIDDEN + 1), np.float32)
            out[..., :HIDDEN] = weights[..., :HIDDEN, :].swapaxes(-1, -2)
            return out

        of_top, of_leaf = with_ones(top), with_ones(leaf)
        by_top, by_leaf = np.zeros_like(top), np.zeros_like(leaf)
        own = np.add.reduceat(h, heads, axis=0)  # of each leaf
        back = of_top[:, :HIDDEN].take(centre // LEAVES, axis=0)
        back += of_leaf.reshape(-1, HIDDEN + 1)[:, :HIDDEN].take(centre, axis=0)
        back *= -1 / n
        for i in range(0, n, WIDE):
            at = slice(i, i + WIDE)
            e = self._exp(h[at] @ top, reach)
            sums = e @ of_top
            share = 1 / (sums[:, HIDDEN:] * n)
            back[at] += sums[:, :HIDDEN] * share
            by_top += (h[at] * share).T @ e
        for part, runs in parts:
            e, sums = np.empty((part.stop - part.start, LEAVES), np.float32), np.empty((part.stop - part.start, HIDDEN + 1), np.float32)
            places = [(g, at, slice(at.start - part.start, at.stop - part.start)) for g, at in runs]
            for g, at, here in places:
                np.matmul(h[at], leaf[g], out=e[here])
            self._exp(e, max(reaches[g] for g, _ in runs))
            for g, _, here in places:
                np.matmul(e[here], of_leaf[g], out=sums[here])
            share = 1 / (sums[:, HIDDEN:] * n)
            back[part] += sums[:, :HIDDEN] * share
            scaled = h[part] * share
            for g, _, here in places:
                np.matmul(scaled[here].T, e[here], out=by_leaf[g])
        by_leaf[used // LEAVES, :, used % LEAVES] -= own / n
        first = np.flatnonzero(np.append(True, used[1:] // LEAVES != used[:-1] // LEAVES))
        by_top[:, used[first] // LEAVES] -= np.add.reduceat(own, first, axis=0).T / n
        step(self.top, square.top, by_top[:HIDDEN])
        step(self.top_bias, square.top_bias, by_top[HIDDEN])
        step(self.leaf, square.leaf, by_leaf[:, :HIDDEN])
        step(self.leaf_bias, square.leaf_bias, by_leaf[:, HIDDEN])
        h = h[:, :HIDDEN]
        back *= 1 - h * h
        for j in range(2 * SIDE):
            order, used, heads = self._sorted(around[:, j])
            total = np.add.reduceat(back.take(order, axis=0), heads, axis=0)
            seen = square.near[j].take(used, axis=0) + total * total
            square.near[j][used] = seen
            self.near[j][used] -= RATE * total / (np.sqrt(seen) + 1e-6)


def around_of(texts: list[np.ndarray], border: int) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours' leaves (left to right, the border beyond a text's ends) and the own leaf of every token of those texts."""
    gap = np.full(SIDE, border, np.int64)
    line = np.concatenate([x for c in texts for x in (gap, c.astype(np.int64))] + [gap])
    at = np.flatnonzero(line != border)
    places = [-s for s in range(SIDE, 0, -1)] + list(range(1, SIDE + 1))
    return np.stack([line[at + s] for s in places], axis=1), line[at]


def slot_counts(docs: DataFrame) -> np.ndarray:
    """How often each slot comes over all texts; each task adds up its own. At most 2**BITS numbers come back."""

    def count(batches):
        total = np.zeros(1 << BITS, np.int64)
        for b in lines(batches):
            held = [slots_of(t.as_py()) for t in b.column(0)]
            slot, n = np.unique(np.concatenate(held), return_counts=True) if held else ([], [])
            total[slot] += n
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["slot", "n"])

    table = materialise(docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")), "slots")
    got = table.toArrow()
    discard(table)
    out = np.zeros(1 << BITS)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


_TOKENS = "doc_id {}, n long, share double, key long, ids binary"


def _tokens(shared):
    """Rows (doc_id, text) to (doc_id, tokens, sum of the words' log shares of their leaves, what deals it to a shard, leaves)."""

    def run(batches):
        v, seen = shared.value, Counter()
        for b in lines(batches):
            n, share, key, ids = [], [], [], []
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                s = slots_of(text.as_py(), v.bits)
                leaf = v.leaf[s].tobytes()
                k = xxhash.xxh3_64_intdigest(leaf, seed=xxhash.xxh32_intdigest(str(doc.as_py())))
                if len(seen) > 200_000:  # a bound on memory; only the dealing of equal rows begins afresh
                    seen.clear()
                seen[k] += 1
                n.append(len(s))
                share.append(float(v.share[s].sum(dtype=np.float64)))
                key.append(xxhash.xxh3_64_intdigest(k.to_bytes(8, "little"), seed=(seen[k] - 1) // LOT) >> 1)
                ids.append(leaf)
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(share, pa.float64()), pa.array(key, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n", "share", "key", "ids"])

    return run


def _shard(table: pa.Table) -> pa.Table:
    """One shard's texts in the order of their keys, as one row (lengths, ids)."""
    key, ids = table.column("key").to_numpy(), table.column("ids").to_pylist()
    order = sorted(range(len(key)), key=lambda i: (key[i], ids[i]))
    held = [ids[i] for i in order]
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "lengths": pa.array([np.array([len(x) // 2 for x in held], np.int64).tobytes()], pa.binary()), "ids": pa.array([b"".join(held)], pa.binary())})


def train_shard(start: np.ndarray, groups: int, lengths: np.ndarray, ids: np.ndarray, round_: int) -> np.ndarray:
    """The parameters after one round over one shard, in the order of its texts."""
    net, square = Window(groups, start), Window(groups, np.full(len(start), 1e-4, np.float32))
    texts = np.split(ids, np.cumsum(lengths)[:-1])
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= BLOCK or i == len(texts) - 1:
            around, centre = around_of(held, groups * LEAVES)
            pick = np.arange(round_, len(centre), ROUNDS)
            for j in range(0, len(pick), STEP_TOKENS):
                net.learn(around[pick[j : j + STEP_TOKENS]], centre[pick[j : j + STEP_TOKENS]], square)
            held, size = [], 0
    return net.flat


def train(tokens: DataFrame, groups: int, whole: np.ndarray) -> Window:
    """Texts are dealt to shards by their ids and words, and each shard trains the network; after a round the parameters' mean is the next start.

    Shards, their order and the mean, a sum of whole numbers, are the same however the rows were partitioned before.
    """
    net = Window(groups, whole=whole)
    total = tokens.agg(F.sum("n")).first()[0] or 0
    if not total:
        return net
    n = -(-total // SHARD_TOKENS)
    tasks = max(1, min(n, tokens.sparkSession.sparkContext.defaultParallelism * 4))
    shards = tokens.filter("n > 0").select(F.pmod("key", F.lit(n)).alias("shard"), "key", "ids")
    shards = materialise(shards.repartition(int(tasks), "shard").groupBy("shard").applyInArrow(_shard, "shard long, lengths binary, ids binary"), "shards")
    context = tokens.sparkSession.sparkContext
    for round_ in range(ROUNDS):
        start = context.broadcast(net.flat)

        def step(batches, start=start, round_=round_):
            total, count = None, 0
            for b in batches:
                for lengths, ids in zip(b.column(0), b.column(1), strict=True):
                    flat = train_shard(start.value, groups, np.frombuffer(lengths.as_buffer(), np.int64), np.frombuffer(ids.as_buffer(), np.uint16), round_)
                    whole = np.rint(flat.astype(np.float64) * SCALE).astype(np.int64)
                    total, count = whole if total is None else total + whole, count + 1
            if count:
                parts = np.array_split(total, 64)
                yield pa.record_batch([pa.array(np.arange(64)), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array(np.full(64, count))], names=["part", "sum", "n"])

        def add(table: pa.Table) -> pa.Table:
            whole = np.sum([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("sum")], axis=0)
            mean = (whole / (SCALE * float(sum(table.column("n").to_pylist())))).astype(np.float32)
            return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "mean": pa.array([mean.tobytes()], pa.binary())})

        sums = shards.select("lengths", "ids").repartition(int(tasks)).mapInArrow(step, "part long, sum binary, n long")
        means = materialise(sums.groupBy("part").applyInArrow(add, "part long, mean binary"), "means")
        net = Window(groups, np.frombuffer(b"".join(r["mean"] for r in sorted(means.collect(), key=lambda r: r["part"])), np.float32))
        discard(means)
        start.destroy()
    discard(shards)
    return net


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, score) for each row of docs: the sum over tokens of the log-probability of the word
    given both sides, and that sum per token.

    The network gives the probability of a word's leaf; a common word has one of its own, rarer ones share the first leaf of a
    group by their corpus counts. Vocabulary and network grow with the corpus: slots up to 2**BITS, leaves up to MOST_GROUPS *
    LEAVES. Counts and training cover all texts, whole, and do not depend on how rows are partitioned. A null text or one
    without words has no tokens, sum 0 and a null score. Repeated rows score alike; other columns are ignored; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    vocabulary = Vocabulary(slot_counts(rows))
    context = rows.sparkSession.sparkContext
    kind = dict(rows.dtypes)["doc_id"]
    tokens = materialise(rows.mapInArrow(_tokens(context.broadcast(vocabulary)), _TOKENS.format(kind)), "tokens")
    groups = vocabulary.groups
    net = train(tokens, groups, vocabulary.whole)
    shared = context.broadcast(net.flat)

    def run(batches):
        own = Window(groups, shared.value)
        for b in lines(batches):
            texts = [np.frombuffer(x.as_buffer(), np.uint16) for x in b.column(3)]
            n = np.array([len(t) for t in texts])
            around, centre = around_of(texts, groups * LEAVES)
            p = np.concatenate([np.zeros(1)] + [own.log_probability(around[i : i + BLOCK], centre[i : i + BLOCK]).astype(np.float64) for i in range(0, len(centre), BLOCK)])
            sums, ends = np.cumsum(p), np.cumsum(n)
            total = (sums[ends] - sums[ends - n] + b.column(2).to_numpy()).tolist()
            mean = [t / k if k else None for t, k in zip(total, n.tolist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(total, pa.float64()), pa.array(mean, pa.float64())], names=["doc_id", "n_tokens", "log_likelihood", "score"])

    return tokens.select("doc_id", "n", "share", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, log_likelihood double, score double")


def op7_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of the whole documents table."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
