"""Each corpus operator against brute force on small tables, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from docrecon.llm import html, language, minhash, mixing, packing, quality, scoring, suffix, urls, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string"
WORDS = "the of and sea stone river under light house morning wind carry open slow field".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([3, 20, 120, 300])) for _ in range(40)]
    base = prose(rng, 200).split()
    for k in range(30):  # a group of near copies, from close to too far
        w = list(base)
        for _ in range(rng.randrange(1, 14)):
            w[rng.randrange(len(w))] = f"x{k}"
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], texts[9], None, "", "   \n ", "one two", "ONE two", prose(rng, 30_000), "spam " * 400, "É ß <|endoftext|> don't 12 _a_ \u1e9e \u0130x Σας", "日本語 の テキスト"]
    texts += [texts[0] + "\n" + texts[1], texts[1] + " " + texts[0]]
    return [(i * 3 % 101, t, None if i % 7 == 0 else ["en", "de"][i % 2], None if i % 9 == 0 else f"s{i % 4}", i, "extra") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_sets(rows):
    out = {}
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out[d] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return out


@pytest.mark.parametrize("small", [minhash.SMALL_BUCKET, 1])
def test_near_duplicates(docs, rows, none, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(minhash, "CELL", 5)
    sets = shingle_sets(rows)
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    for d, s in sets.items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (len(s), top(d), top(d) == d)
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_null_and_repeated_ids(spark):
    got = minhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "d e f"), (2, "d e f")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, bool(r["kept"])) for r in got) == [(0, 0, False), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_passages(docs, rows, none):
    first, want = {}, {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], d) < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.passage_digest(docs).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 1000
    assert suffix.passage_digest(none).count() == 0
    out = suffix.remove_passages(docs)
    assert out.schema == docs.schema and out.count() == len(rows)


def test_deep_shallow_orders_suffixes():
    rng = random.Random(3)
    text = bytes(rng.choice(b"ab") for _ in range(3000)) + b"abcabcabc" * 60 + bytes(100)
    at = np.arange(len(text) - 100)
    order, runs = suffix.deep_shallow(np.frombuffer(text, np.uint8), at, depth=50, shallow=8)
    keys = [text[i : i + 50] for i in order.tolist()]
    assert keys == sorted(keys)
    assert runs.tolist() == [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
    order, _ = suffix.multikey_quicksort(np.frombuffer(text, np.uint8), at, 16, small=10)
    keys = [text[i : i + 16] for i in order.tolist()]
    assert keys == sorted(keys)


def test_packing(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = {d: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for d, x, *_ in rows}
    pieces, fill = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs).collect():
        pieces[r["doc_id"]].append(r)
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, x in ids.items():
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(x))
            assert r["ids_crc32"] == zlib.crc32(x[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(x)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert packing.pack(none).count() == 0


def test_patterns_hold_the_histogram():
    rng = random.Random(1)
    histogram = {n: rng.randrange(0, 900) for n in range(1, 64)} | {n: rng.randrange(0, 900) for n in range(64, 2048, 64)}
    held, sequences = defaultdict(int), 0
    for n, pattern in packing.patterns(histogram):
        assert sum(k * c for k, c in pattern.items()) <= packing.SEQUENCE
        sequences += n
        for k, c in pattern.items():
            held[k] += n * c
    assert {k: c for k, c in histogram.items() if c} == dict(held)
    assert sequences <= 1.002 * sum(k * c for k, c in histogram.items()) / packing.SEQUENCE + 2


def test_quality(docs, rows, none):
    import re

    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 2000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
        covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or "")) and r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert quality.quality_filter(docs).columns == docs.columns
    assert quality.quality(none).count() == 0


def test_mixing(docs, rows, none):
    got = mixing.mix_report(docs).collect()
    again = mixing.mix_report(docs.repartition(2)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    largest = max(r["size"] for r in got)
    for s in sizes:
        assert target[s] <= 2 * sizes[s] + 1e-9 and abs(taken[s] - target[s]) <= largest / 2 + 1
    copies = mixing.mix(docs).groupBy("doc_id").count().collect()
    want = {r["doc_id"]: r["taken"] // r["size"] for r in got if r["size"] and r["taken"]}
    assert {r["doc_id"]: r["count"] for r in copies if r["doc_id"] in {x["doc_id"] for x in got if x["size"]}} == want
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0


def test_language(spark, none):
    rng = random.Random(2)
    kinds = {"en": "the and of thing stone where with", "de": "der und nicht ich schön über straße", "fr": "le une être où garçon très avec"}
    rows = [(i, " ".join(rng.choice(kinds[k].split()) for _ in range(40)), k) for i, k in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, None, "en"), (901, "12 !!", "de"), (902, "", None), (903, rows[0][1] + " " + rows[1][1], None), (904, "A", None)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [r for r in rows[:180] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]]["held_out"] for r in held) and sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[904]["lang_pred"] in kinds
    assert got[903]["lang_pred"] in ("en", "de") and 0.4 < got[903]["score"] < 0.7
    assert language.identify(none).count() == 0


def test_urls(spark):
    urls_ = [f"https://h{i}.example.{'net' if i % 2 else 'org'}/{'en' if i % 3 else 'fr'}/{i}" for i in range(200)]
    urls_ += ["HTTP://A.Example.COM/de/x?y#z", "http://net/", "ftp://notexample.com/de/", None, "no scheme", "x://h?a://b/c", "http://example.net", ""]
    got = {r["page_id"]: r for r in urls.url_verdicts(spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")).collect()}
    assert len(got) == len(urls_)
    assert tuple(got[200])[1:] == ("a.example.com", "/de/x", "example.com/de/", "block")
    assert tuple(got[201])[1:] == ("net", "/", "net/", "block")
    assert got[202]["rule"] is None and got[203]["host"] == got[204]["host"] == "" and (got[205]["host"], got[205]["path"]) == ("h", "")
    for i in range(200):
        rule = ("example.net/en/", "allow") if i % 2 and i % 3 else ("net/", "block") if i % 2 else ("org/fr/", "allow") if i % 3 == 0 else None
        assert got[i]["rule"] == (rule and rule[0]) and got[i]["verdict"] in ((rule[1],) if rule else ("allow", "block"))
    assert urls.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_BYTES", 300 * 16 * 8)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 10 * 16 * 8)
    monkeypatch.setattr(vectors, "TASK_BLOCKS", 2)
    monkeypatch.setattr(vectors, "MERGE", 2)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(800, 16)).astype(np.float32) * rng.uniform(0.5, 2, (800, 1)).astype(np.float32)
    v[100:200] = v[100]
    rows = [(i, v[i].tolist(), "x", 1) for i in range(800)] + [(1000, None, "", 0), (1020, [0.0] * 16, "", 0), (1040, [float("nan")] * 16, "", 0), (1060, [None] + [1.0] * 15, "", 0)]
    rows += [(2000, [1.0, 2.0], "", 0), (2001, [1.0, 1.0], "", 0), (2020, [3.0], "", 0), (40, v[40].tolist(), "again", 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string, id int")
    for factor, least in ((1.0, 1.0), (None, 0.9)):
        got = defaultdict(list)
        for r in vectors.nearest(frame, factor=factor).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert got.pop(2000) == [(2001, 3.0)]
        hits = 0
        w = v.astype(np.float64)
        for q in range(0, 800, 20):
            s = (w[q] * w).sum(axis=1)
            want = [i for i in np.lexsort((np.arange(800), -s)).tolist() if i != q][:20]
            hits += len(set(want) & {i for i, _ in got[q]})
            if least == 1.0:
                assert [i for i, _ in got[q]] == want and [x for _, x in got[q]] == s[want].tolist()
        assert hits >= least * 20 * 40 and set(got) == set(range(0, 800, 20))
    assert vectors.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("kind", ["clusters", "sphere"])
def test_trees_of_a_full_shard(kind):
    """At the size of a shard the measured factor keeps recall, and prunes where the vectors have structure."""
    rng = np.random.default_rng(5)
    n = vectors.SHARD_BYTES // (64 * 8)
    x = rng.normal(size=(n, 64)) if kind == "sphere" else rng.normal(size=(200, 64))[rng.integers(0, 200, n)] + 0.3 * rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = vectors.VantagePointTree(x)
    factor = tree.measured_factor(x[np.linspace(0, n - 1, vectors.SAMPLE).astype(int)], 21)
    q = x[7::40]
    found, _, visited = tree.search(q, 21, factor)
    true = np.argpartition(-(q @ x.T), 20, axis=1)[:, :21]
    recall = sum(len(set(a) & set(b)) for a, b in zip(found.tolist(), true.tolist(), strict=True)) / true.size
    assert recall >= 0.9
    if kind == "clusters":
        assert visited.mean() < 0.4 * tree.leaves
    exact, _, _ = tree.search(q[:50], 21, 1.0)
    assert all(set(a) == set(b) for a, b in zip(exact.tolist(), true[:50].tolist(), strict=True))


def test_neighbours_of_the_table(spark):
    d = "/root/testdata/sf0.01"
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    ids, w = np.array(list(rows)), np.stack(list(rows.values()))
    got = defaultdict(set)
    for r in vectors.op5_neighbours(spark, d).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in (i for i in ids.tolist() if i % 20 == 0):
        order = [i for i in ids[np.argsort(-(w @ rows[q]), kind="stable")].tolist() if i != q][:20]
        hits += len(got[q] & set(order))
    assert hits >= 0.9 * 20 * len(got)


PAGE = """<html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header>Site name</header><nav><ul><li><a href="/">Home</a></li><li>News</li></ul></nav>
<div class="cookie-notice">We use cookies here</div><article><h1>Head &amp; {0}</h1><p>First  words\n of the {0} story<br>go on here &lt;now&gt;.</p><div class="ad">Buy this</div><p>Second part of {0}, which is longer.</p></article>
<section id="comments"><p>Nice story, thanks a lot</p></section><aside>Other</aside><form>Name<input></form><footer>&copy; Site</footer></body></html>"""


def test_html(spark):
    rows = [(i, f"u{i}", PAGE.format(f"w{i}")) for i in range(30)]
    rows += [(30, "u", rows[0][2].replace("<article>", "<div>").replace("</article>", "</div>")), (31, None, None), (32, "u", ""), (33, "u", "<nav>a</nav>"), (34, "u", "<p>open <b>text")]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(31):
        w = f"w{i % 30}"
        want = f"Head & {w} First words of the {w} story go on here <now>. Second part of {w}, which is longer."
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)
    assert [got[i]["text"] for i in (31, 32, 33, 34)] == ["", "", "", "open text"]


def test_best_span_is_the_maximum_segment():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randrange(0, 12)
        scores, costs = [rng.uniform(-3, 3) for _ in range(n)], [-rng.uniform(0, 2) for _ in range(n)]
        total = lambda lo, hi: sum(scores[lo:hi]) + sum(costs[lo + 1 : hi])  # noqa: E731, B023
        want = max([0.0] + [total(i, j) for i in range(n) for j in range(i + 1, n + 1)])
        lo, hi = html.best_span(scores, costs)
        assert abs(total(lo, hi) - want) < 1e-9


def test_the_scan_removes_furniture_by_learned_weights(spark):
    """Names that no list has: the labelled pages alone tell that zq and the figures' captions are no main text, and that wx is."""
    page = '<html><body><div class="zq">Menu of the site {0}</div>{1}<div class="wx">Lead of {0} story</div><p>The text of story {0} goes on and on.</p><blockquote>quoted</blockquote><table><tr><td>a</td><td>b</td></tr></table>{2}<center>Other stories of the site</center><div class="zq">Imprint</div></body></html>'
    rows = [(i, "u", page.format(i, "<article>", "</article>")) for i in range(60)] + [(99, "u", page.format(99, "<div>", "</div>"))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[99] == "Lead of 99 story The text of story 99 goes on and on. quoted a b" and got[5] == got[99].replace("99", "5")
    assert html.main_text(rows[-1][2], html.Weights()) != got[99]


def test_article_content_stays():
    page = '<body><nav>Home</nav><article><h1>T</h1><p>One two.</p><div class="share-price">Price 12</div><p class="comment-free">free of it</p><h2 id="login">How to log in</h2><blockquote>q</blockquote><table><tr><td>a</td><td>b</td></tr></table><pre>code</pre></article><footer>f</footer></body>'
    assert html.main_text(page, html.Weights()) == "T One two. Price 12 free of it How to log in q a b code"


def test_html_edges(spark):
    long = "<article>" + "<p>word after word.</p>" * 30_000 + "</article>"
    rows = [(1, "u", long, "x", 1), (1, "u", long, "x", 2), (None, None, "<p>a\u00a0\u2003b</p>", "y", 3)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, signs int")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 3), (1, 509_999), (1, 509_999)]
    assert next(r["text"] for r in got if r["page_id"] is None) == "a b"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_scoring(docs, rows, none):
    got = {r["doc_id"]: r for r in scoring.score(docs).collect()}
    assert len(got) == len(rows)
    for d, t, *_ in rows:
        n = len((t or "").split())
        assert got[d]["n_tokens"] == n and (got[d]["score"] is None) == (n == 0) and got[d]["log_likelihood"] <= 0
    assert scoring.score(none).count() == 0
    again = scoring.score(docs.coalesce(1)).collect()
    assert all(abs(r["log_likelihood"] - got[r["doc_id"]]["log_likelihood"]) <= 1e-4 * (1 + r["n_tokens"]) for r in again)


def test_scores_by_hand(docs, rows, spark):
    """A text's score from the trained network, word by word, over the whole vocabulary."""
    plain = docs.select("doc_id", "text")
    v = scoring.Vocabulary(scoring.slot_counts(plain))
    tokens = plain.mapInArrow(scoring._tokens(spark.sparkContext.broadcast(v)), scoring._TOKENS.format("bigint"))
    net = scoring.train(tokens, v.groups, v.whole)
    got = {r["doc_id"]: r["log_likelihood"] for r in scoring.score(docs).collect()}
    border = v.groups * scoring.LEAVES
    for d, t, *_ in rows[:12]:
        slots = scoring.slots_of(t, v.bits).tolist()
        leaves, total = [int(v.leaf[s]) for s in slots], 0.0
        for i, (s, leaf) in enumerate(zip(slots, leaves, strict=True)):
            around = [leaves[i + k] if 0 <= i + k < len(leaves) else border for k in (-2, -1, 1, 2)]
            h = np.tanh(sum(net.near[j][a].astype(float) for j, a in enumerate(around)))
            z = h @ net.top + net.top_bias
            p = np.exp(z) / np.exp(z).sum()
            q = [np.exp(h @ net.leaf[g] + net.leaf_bias[g]) for g in range(v.groups)]
            whole = np.concatenate([p[g] * x / x.sum() for g, x in enumerate(q)])
            assert abs(whole.sum() - 1) < 1e-6
            total += np.log(whole[leaf]) + v.share[s]
        assert abs(total - got[d]) <= 1e-3 * (1 + len(slots))
    used = np.flatnonzero(np.bincount([s for _, t, *_ in rows for s in scoring.slots_of(t, v.bits).tolist()], minlength=1 << v.bits))
    mass = np.bincount(v.leaf[used], np.exp(v.share[used].astype(float)))
    assert np.allclose(mass[mass > 0], 1, atol=1e-4)  # the words of a leaf share it


def test_vocabulary_grows():
    small, large = (scoring.Vocabulary(np.concatenate([np.ones(n), np.zeros((1 << scoring.BITS) - n)])) for n in (2_000, 900_000))
    assert (small.bits, small.groups) == (14, 8) and (large.bits, large.groups) == (22, 64)


def test_scoring_learns_both_sides():
    rng = np.random.default_rng(1)
    left = rng.integers(1, 40, 30_000)
    texts = list(np.stack([left, left % 20 + 50, (left * 7) % 20 + 80], axis=1))
    around, centre = scoring.around_of(texts, 4 * scoring.LEAVES)
    net, square = scoring.Window(4), None
    square = scoring.Window(4, np.full(len(net.flat), 1e-4, np.float32))
    before = net.log_probability(around, centre).mean()
    for i in range(0, len(centre), scoring.STEP_TOKENS):
        net.learn(around[i : i + scoring.STEP_TOKENS], centre[i : i + scoring.STEP_TOKENS], square)
    assert net.log_probability(around, centre).mean() > before + 1.0
    assert around[0].tolist() == [256, 256, *texts[0][1:].tolist()]


def test_url_trees_learn(spark):
    """Digits in the path mark what is blocked: the trees find it where no rule speaks."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    digits = lambda: "".join(rng.choice("0123456789") for _ in range(24))
    urls_ = [f"https://{word()}.net/{digits()}" for _ in range(300)] + [f"https://{word()}.org/fr/{word()}" for _ in range(300)]
    asked = [f"https://{word()}.info/{digits()}" for _ in range(50)] + [f"https://{word()}.info/fr/{word()}" for _ in range(50)]
    asked += [asked[0], "https://long.info/" + "1" * 20_000]
    rows = [(i, u, "x", "y") for i, u in enumerate(urls_ + asked)]
    got = {r["page_id"]: r["verdict"] for r in urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, bad string, label string")).collect()}
    assert len(got) == len(rows)
    assert sum(got[600 + i] == "block" for i in range(50)) >= 48 and sum(got[650 + i] == "allow" for i in range(50)) >= 48
    assert got[700] == got[600]


def test_url_suffix_shares_leave_the_own_label_out(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(urls.GBTClassifier, "fit", lambda self, frame: seen.append(frame) or (_ for _ in ()).throw(KeyError("stop")))
    rows = [(0, "https://a.net/x.html"), (1, "https://b.org/fr/x.html"), (2, "https://c.net/y")]
    with pytest.raises(KeyError):
        urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"))
    at = urls.FEATURES.index("host_suffix")
    got = sorted((r["label"], round(r["features"][at], 6)) for r in seen[0].collect())
    prior = 2 / 3
    assert got == sorted([(1.0, round((1 + 10 * prior) / 11, 6))] * 2 + [(0.0, round(prior, 6))])


def test_letters(spark):
    rows = [(1, "\u00b2", None), (2, "\u00bd \u00bd", None), (3, "\u2167", None), (4, "_ 12 \u0301", None), (5, "\u5b57", None), (6, "\u00aa", None)] + [(100 + i, "the of and", "en") for i in range(20)]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i] for i in range(1, 7)] == ["und", "und", "und", "und", "en", "en"]


def test_inclusion_is_unequal_and_exact(spark, docs, rows):
    table = spark.createDataFrame([("a", float(g), 100.0 * g, 1100.0) for g in range(1, 8)] + [("b", 1.0, 50.0, 0.0), (None, 3.0, 10.0, 5.0)], "source string, g double, words double, want double")
    got = mixing.inclusion(table).collect()
    a = sorted((r["g"], r["pi"]) for r in got if r["source"] == "a")
    assert len({round(p, 9) for _, p in a}) > 3 and abs(sum(100 * g * p for g, p in a) - 1100) < 1e-9
    assert all(p <= 1 for _, p in a) and a == sorted(a, key=lambda x: x[1])
    assert {r["source"]: r["pi"] for r in got if r["source"] != "a"} == {"b": 0.0, None: 0.5}


def test_mixing_salted(docs, monkeypatch):
    want = sorted(map(tuple, mixing.mix_report(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, mixing.mix_report(docs).collect())) == want


def test_scratch_goes(spark, docs):
    from docrecon.llm import common

    before = set(common._made)
    with common.scratch_scope() as kept:
        out = minhash.near_duplicates(docs)
        kept.append(out)
        assert len(set(common._made) - before) == 1
    common.discard(out, docs)
    assert set(common._made) == before


NAMES = "i t u v n p x g id key bin fp rep size chunk blob hashes label source_size copies pi want plan mix_plan quality q part k base rank"


def test_stages_on_hard_tables(spark):
    """Nulls in any column, repeated rows, ties, an empty table and columns that share names with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in NAMES.split())
    extra = tuple("e" for _ in NAMES.split())
    rng = random.Random(8)
    a, b = prose(rng, 300), prose(rng, 200)
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (None, b, None, None, None), (2, None, None, "s", 0), (3, "", "en", None, 0), (4, a + " " + b, "en", "s", 9), (None, None, None, None, None)]
    for table in (spark.createDataFrame([(*r, *extra) for r in rows], schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, "")
            assert out.count() >= 0, name
            if name != "packing":
                assert out.schema.names == table.schema.names


def test_pipeline_by_brute_force(spark, docs, rows, tmp_path):
    """Each stage of the pipeline against plain Python on its own input."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    n = 0
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in table.collect()}
        out = stage(spark, table, str(tmp_path)).collect()
        if name == "quality rules":
            kept = {d for d, t in before.items() if len((t or "").split()) >= 50}
            assert {r["doc_id"] for r in out} <= kept and len(out) > 20
        elif name == "minhash near-dedup":
            sets = shingle_sets(list(before.items()))
            root = {d: d for d in sets}
            for _ in sets:
                for x in sets:
                    for y in sets:
                        both = len(sets[x] & sets[y])
                        if x < y and 100 * both >= 75 * len(sets[x] | sets[y]):
                            root[y] = root[x] = min(root[x], root[y])
                if n == (n := sum(root.values())):
                    break
            assert {r["doc_id"] for r in out} == {d for d in sets if root[d] == d}
        elif name == "suffix-array dedup":
            first: dict = {}
            for d, t in sorted(before.items()):
                raw = t.encode()
                gone = bytearray(len(raw))
                for i in range(len(raw) - 49):
                    if first.setdefault(raw[i : i + 50], d) < d:
                        gone[i : i + 50] = b"\1" * 50
                before[d] = bytes(x for x, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
            assert {r["doc_id"]: r["text"] for r in out} == before
        elif name == "source mix":
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix_report(table).collect()}
            words = defaultdict(int)
            for r in out:
                assert r["text"] == before[r["doc_id"]]
                words[r["doc_id"]] += len(r["text"].split())
            assert all(words[d] == t for d, t in taken.items())
        else:
            copies = defaultdict(int)
            for r in table.collect():
                copies[r["doc_id"]] += 1
            length = defaultdict(int)
            for r in out:
                length[r["doc_id"], r["doc_tokens"]] += r["length"]
            assert {(d, total // copies[d]) for (d, _), total in length.items()} == set(length)
            return
        table = spark.createDataFrame(out, docs.schema)


def test_pipeline_stages(spark, docs):
    table = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, "")
        assert table.columns == docs.columns, name
        table = spark.createDataFrame(table.collect(), docs.schema)
        assert table.count() > 0
    assert set(corpus_pipeline.STAGES[-1][1](spark, table, "").columns) >= {"doc_id", "start", "length", "sequence_id"}


def test_quality_filter_drops_labelled_junk(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels, "doc_id")
    passed = quality.quality(docs).filter("not base_failed").select("doc_id").join(labels, "doc_id")
    kept = {r["doc_id"] for r in quality.quality_filter(docs).select("doc_id").collect()}
    clean, junk = ({r["doc_id"] for r in passed.filter(f"quality = {q}").collect()} for q in (1, 0))
    assert clean and junk and clean <= kept and not junk & kept
    assert kept == {r["doc_id"] for r in quality.quality(docs).filter("kept").collect()}


@pytest.mark.parametrize("wrapper", ['div class="overflow-hidden"', "div style='overflow:hidden'", 'div class="has-sidebar"', 'div class="page no-sidebar"', 'div class="layout--with-sidebar"', "div class='sidebar-layout sidebar'", 'div data-state="hidden"', 'div aria-hidden="false"', 'div title="display:none"'])
@pytest.mark.parametrize("inner", ["article", "main"])
def test_wrapped_articles_stay(wrapper, inner):
    page = f'<body><nav>Home</nav><{wrapper}><{inner}><p>The whole story of the sea and its stones.</p></{inner}></div><footer>Site</footer></body>'
    assert html.main_text(page, html.Weights()) == "The whole story of the sea and its stones."


@pytest.mark.parametrize("tag", ["div hidden", 'div hidden=""', 'div class="a" hidden="hidden"', 'div aria-hidden="true"', 'div style="color:red; display : none"', 'div class="sidebar"', 'div class="comments"'])
def test_hidden_and_furniture_go(tag):
    page = f"<article><p>The whole story of the sea.</p><{tag}><p>Not of it at all</p></div><p>Its end.</p></article><{tag}><article><p>A reply to the story</p></article></div>"
    assert html.main_text(page, html.Weights()) == "The whole story of the sea. Its end."


def test_four_languages_share_a_text():
    logp = np.log(np.full((5, 100), 0.1 / 80))
    for k in range(5):
        logp[k, k * 20 : k * 20 + 20] = np.log(0.9 / 20)
    counts = np.zeros((3, 100), np.int32)
    counts[0, :80] = np.repeat([70, 50, 45, 35], 20)  # four languages
    counts[1] = np.repeat([30, 25, 20, 15, 10], 20) * 3  # all five
    counts[2, 20:40] = 50  # one
    best, score = language.judge(counts, logp)
    assert best.tolist() == [0, 0, 1] and score[2] == 1.0
    for row, n in ((0, 4), (1, 5)):
        share = np.full(5, 0.0)
        share[:n] = 1 / n
        for _ in range(5000):  # brute force: expectation-maximisation to its fixed point
            r = share[:, None] * np.exp(logp)
            share = (r / r.sum(axis=0) * counts[row]).sum(axis=1) / counts[row].sum()
        assert abs(score[row] - share.max()) < 0.01


def test_mixture_bound_holds():
    rng = np.random.default_rng(3)
    p = rng.uniform(0.01, 1, (40, 3))
    c = rng.integers(1, 20, 40).astype(float)
    _, likelihood, gap = language._mixture(np.zeros(40, int), np.array([0]), c, p, np.ones((1, 3)))
    shares = rng.dirichlet(np.ones(3), 20_000)
    assert (c * np.log(shares @ p.T)).sum(axis=1).max() <= likelihood[0] + gap[0] + 1e-9


@pytest.mark.parametrize("kind", ["random", "path", "hub", "loops", "none"])
def test_components(spark, kind):
    """Against a union-find: scattered edges, a long path, a node of very many neighbours, only loops, no edges."""
    from docrecon.llm.graph import components

    rng = np.random.default_rng(5)
    order = rng.permutation(60).tolist()
    edges = {
        "random": rng.integers(0, 300, (180, 2)).tolist(),
        "path": list(zip(order, order[1:], strict=False)),
        "hub": [(700, i) for i in range(500)] + [(i, i + 1000) for i in range(0, 500, 7)],
        "loops": [(3, 3), (4, 4)],
        "none": [],
    }[kind]
    parent: dict = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = top(u), top(v)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame([(int(u), int(v)) for u, v in edges], "u long, v long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, top(x)) for x in parent)


@pytest.mark.parametrize("bits", [minhash.FILTER_BITS, 128])
def test_without_ids(spark, monkeypatch, bits):
    """Rows of the ids go, all others stay, whether the filter tells them apart or hardly any."""
    monkeypatch.setattr(minhash, "FILTER_BITS", bits)
    rows = [(i % 700, f"t{i}", i) for i in range(900)] + [(None, "null", 1), (-5, "minus", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, bits string, word long")
    ids = [*range(0, 700, 9), -5, 10**15, None]
    out = minhash.without_ids(docs, spark.createDataFrame([(i,) for i in ids + ids], "x long"))
    assert out.schema == docs.schema
    assert sorted(map(repr, out.collect())) == sorted(repr(r) for r in docs.collect() if r["doc_id"] is None or r["doc_id"] not in ids)
    assert minhash.without_ids(docs, spark.createDataFrame([], "x long")).count() == len(rows)


@pytest.mark.parametrize("page", ["<div class=a>w" * 100_000, "<p>w<div>" * 50_000, "<li>a<ul>" * 50_000, "<b>" * 100_000 + "w"])
def test_deep_nesting_takes_linear_time(page):
    import time

    start = time.process_time()
    found = list(html.blocks(page))
    assert found and found[-1].text in ("w", "a") and time.process_time() - start < 20
