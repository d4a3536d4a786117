"""Operators on token ids and the resampling, against the libraries' own encoding of whole texts and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docrecon.llm import alignment, resampling, tokenfile, tokens

SCHEMA = "doc_id long, text string, lang string, b int, row string, rank string, first long, bucket string, k long, h long, ids binary"
WORDS = "the of and sea stone river under light house morning wind carry open slow field Straße été niño don't it's".split()
CHARS = " \t\n\r\x0b\xa0\u1680\u2003\u2028\u202f\u205f\u3000 ab's\xe91,.<|\u65e5\u2581\x1c\x85\xd7\xf7\xba\xaa"
SPECIAL = "<|endoftext|>"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", ",", ".\n", "  ", "\n\n", "!?", " 12"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = [prose(rng, rng.choice([1, 3, 25, 120])) for _ in range(60)]
    texts += ["".join(rng.choice(CHARS) if rng.random() < 0.97 else SPECIAL for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    texts += [None, "", " ", "  ", "\n", "\r\n", SPECIAL, f"a {SPECIAL}", f"a  {SPECIAL} b", "a▁b", "x" * 3000, prose(rng, 20_000), "the\r the\r  the", "  lead", "tail  ", texts[0], texts[1].upper()]
    ids = [*range(2, 2 * len(texts), 2)]
    rng.shuffle(ids)
    out = [(i, t) for i, t in zip([*ids, 1], texts, strict=True)]
    out += [out[0], out[0], (out[1][0], "another text of an id that is there twice"), (None, "a text without an id"), (None, None)]
    return [(*r, "en", 1, "r", "x", 5, "y", 6, 7, b"z") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def whole():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json"))
    return t, sentencepiece.SentencePieceProcessor(model_file=tokens.public_path("piece_bpe_32k.model"))


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# token files


def test_token_ids(spark, docs, rows, whole, tmp_path):
    path = f"file://{tmp_path}/ids"
    tokenfile.write(docs, path)
    got = tokenfile.read(spark, path).orderBy("start").collect()
    ids = [(r[0], np.array(whole[0].encode(r[1] or "", add_special_tokens=False).ids + [tokenfile.END_ID], "<u4").tobytes()) for r in rows]
    same([(r["doc_id"], bytes(r["ids"])) for r in got], ids)
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]) // 4)
        at += r["n_tokens"]
    order = [-math.inf if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)
    one = rows[0][0]
    same([x.tobytes() for x in tokenfile.document(path, one)], [x for d, x in ids if d == one])
    assert tokenfile.document(path, -5) == []


def test_token_ids_do_not_depend_on_tasks(spark, docs, tmp_path):
    seen = []
    for k, table in enumerate((docs, docs.repartition(1).sortWithinPartitions("lang"))):
        tokenfile.write(table, f"file://{tmp_path}/{k}")
        seen.append([tuple(r) for r in tokenfile.read(spark, f"file://{tmp_path}/{k}").orderBy("start").collect()])
    assert seen[0] == seen[1]


def test_no_token_files(spark, none, tmp_path):
    tokenfile.write(none, f"file://{tmp_path}/none")
    assert tokenfile.read(spark, f"file://{tmp_path}/none").collect() == []


def test_files_of_lost_attempts_are_not_read(spark, docs, rows, tmp_path):
    tokenfile.write(docs, f"file://{tmp_path}/a")
    (tmp_path / "a/ids-000000-lost.tok").write_bytes(b"half a file")
    assert tokenfile.read(spark, f"file://{tmp_path}/a").count() == len(rows)


def test_another_dictionary_is_refused(spark, docs, tmp_path):
    import json

    tokenfile.write(docs, f"file://{tmp_path}/b")
    about = json.loads((tmp_path / "b/manifest.json").read_text())
    assert about["dictionary"] and hashlib.sha256((tmp_path / "b" / about["dictionary"]).read_bytes()).hexdigest() == about["dictionary_sha256"]
    (tmp_path / "b/manifest.json").write_text(json.dumps(about | {"dictionary_sha256": "0" * 64}))
    with pytest.raises(Exception, match="another dictionary"):
        tokenfile.read(spark, f"file://{tmp_path}/b").count()
    f = next((tmp_path / "b").glob("ids-*.tok"))
    (tmp_path / "b/manifest.json").write_text(json.dumps(about | {"files": [[f.name, 1, 1]]}))
    raw = bytearray(f.read_bytes())
    raw[-80] ^= 1
    f.write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        tokenfile.read(spark, f"file://{tmp_path}/b").count()


def test_frames_hold_wide_ids():
    frames = tokenfile.Frames(b"", 4)
    ids = np.array([1, 70_000, 2**31], "<u4")
    assert frames.ids(frames.pack(ids)).tolist() == ids.tolist()


def test_units_are_remembered_and_forgotten(whole):
    units = tokens.UnitIds(tokens.ByteIds(tokens.public_path("byte_bpe_50k.json"), False))
    units.most_units = 10
    for text in ["one two three", "four five six seven eight nine ten eleven", "one two", "twelve"]:
        ids, at = units.of(pa.array([text]))
        assert (ids.tolist(), at.tolist()) == (whole[0].encode(text).ids, [0, len(ids)])


# alignment


def brute_alignment(rows, whole):
    t, s = whole
    t.encode_special_tokens = True
    pieces = {i: x.encode("latin-1") for i, x in tokens.byte_pieces(t).items()}
    model = tokens.PieceIds(tokens.public_path("piece_bpe_32k.model"))
    out, count = [], Counter()
    for d, text, *_ in rows:
        raw = (" " + text).encode() if text else b""
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = s.encode(text) if text else []
        x, y = [pieces[i] for i in a], [model.pieces[i] for i in b]
        if b"".join(x) != raw or b"".join(y) != raw:
            a = b = x = y = []
        links, groups, ga, gb = [], [], [], []
        i = j = at_a = at_b = 0
        while i < len(a):
            links.append((a[i], b[j]))
            end_a, end_b = at_a + len(x[i]), at_b + len(y[j])
            if end_a <= end_b:
                ga.append(a[i])
                at_a, i = end_a, i + 1
            if end_b <= end_a:
                gb.append(b[j])
                at_b, j = end_b, j + 1
            if end_a == end_b:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        count.update(links)
        text = ";".join(groups)
        out.append((d, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if groups else "", text))
    t.encode_special_tokens = False
    top = Counter()
    for (_, b), c in count.items():
        top[b] = max(top[b], c)
    return [(d, na, nb, ng, len(k), sum(count[x] == top[x[1]] for x in k), sum(count[x] for x in k), sha, text) for d, na, nb, ng, k, sha, text in out]


@pytest.mark.parametrize("hot", [alignment.HOT, 20])
def test_alignment(docs, rows, none, whole, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    monkeypatch.setattr(alignment, "SLICE", 7)
    want = brute_alignment(rows, whole)
    assert sum(w[1] for w in want) > 20_000 and any(w[1] == 0 for w in want)
    got = alignment.align(docs, groups=True).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups").collect()
    same([tuple(r) for r in got], want)
    assert alignment.align(none).count() == 0


def test_cogroup_sums_in_between(monkeypatch, docs, rows, whole):
    """A stream whose counts and contributions are summed up again and again gives the same."""
    rng = random.Random(2)
    posts = [(rng.randrange(3), rng.randrange(5), rng.randrange(4), rng.randrange(1, 9)) for _ in range(300)]
    posts = {p[:3]: p[3] for p in posts}
    count = Counter()
    for (b, a, _), n in posts.items():
        count[b, a] += n
    want = Counter()
    for (b, a, d), n in posts.items():
        want[d, "sum"] += n * count[b, a]
        want[d, "best"] += n * (count[b, a] == max(c for (x, _), c in count.items() if x == b))
    keys = sorted((b << 32 | a, d, n) for (b, a, d), n in posts.items())
    block = alignment._blocks(*(np.array(x, np.int64) for x in zip(*keys, strict=True)), 100)
    cols = {n: block.column(i) for i, (n, _) in enumerate(alignment._ROW)}
    empty, stream = pa.nulls(1, pa.binary()), []
    for i in range(block.num_rows):
        at = {n: c.slice(i, 1) for n, c in cols.items()}
        for kind in (0, 1):
            parts = [at["b"], pa.array([0], pa.int32()), pa.array([kind], pa.int32()), at["first"], at["a"]] + ([at["links"], empty, empty, empty] if kind == 0 else [empty, at["runs"], at["docs"], at["times"]])
            stream.append(pa.record_batch(parts, names=["b", "salt", "kind", "first", "a", "links", "runs", "docs", "times"]))
    monkeypatch.setattr(alignment, "GATHERED", 2)
    got = Counter()
    parts = list(alignment._cogroup(iter(stream)))
    assert len(parts) >= 3
    for out in alignment._shares(iter(parts)):
        for r in out.to_pylist():
            got[r["row"] - 100, "best"] += r["n_best"]
            got[r["row"] - 100, "sum"] += r["count_sum"]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


# resampling


def brute_resampling(rows, target):
    low = str.maketrans(resampling._UPPER, resampling._LOWER)
    feats = lambda t: [zlib.crc32(w.encode()) % resampling.BUCKETS for w in re.findall(resampling.FEATURE_PATTERN, (t or "").translate(low))]
    s, t = Counter(b for r in rows for b in feats(r[1])), Counter(b for x in target for b in feats(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + resampling.BUCKETS) / ((s[b] + 1) * (big_t + resampling.BUCKETS)))) for b in range(resampling.BUCKETS)]
    out = []
    for d, text, *_ in rows:
        f = feats(text)
        h = int(hashlib.sha256(f"{resampling.SEED}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    many = sorted((r for r in out if r[1] >= resampling.MIN_FEATURES), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1]))
    for k, r in enumerate(many[: 10 * len(many) // 100]):
        r[4] = k + 1
    return [tuple(r) for r in out]


TARGET = ["the sea and the stone", None, "", "morning WIND 12 été", "the the the"]


def test_resampling(spark, docs, rows, none):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    want = brute_resampling(rows, TARGET)
    got = resampling.resample(docs, target).collect()
    assert got[0].asDict().keys() == {"doc_id", "n_features", "weight", "score", "rank"}
    same([tuple(r) for r in got], want)
    assert sum(w[4] is not None for w in want) >= 3
    assert resampling.resample(none, target).count() == 0
    same([tuple(r) for r in resampling.resample(docs, target.limit(0)).collect()], brute_resampling(rows, []))


def test_resampling_ties_and_repeated_rows(spark):
    """Ties go to the smaller id; rows that repeat an id are ranked one by one."""
    text = " ".join(["sea"] * 30)
    rows = [(5, text)] * 300 + [(i, text) for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = resampling.resample(table, table, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 161))
    order = [(-r["score"], r["doc_id"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])]
    assert order == sorted(order)
