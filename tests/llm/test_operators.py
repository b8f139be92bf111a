"""Each operator against brute force on small fixtures, and on odd tables."""

from __future__ import annotations

import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corposieve.llm import decontaminate, license_scan, line_dedup, lm_score, mixing, near_dup, quality_model, quality_rules, sharding, warc
from corposieve.llm._text import shingles, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = " \t\n\x0b\x0c\r"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(5), []
    for i in range(90):
        text = "\n".join(prose(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 6)))
        out.append((i, text, "en", f"s{i % 3}", len(text)))
    for i in range(90, 130):  # near copies of a few
        parts = out[i % 5][1].split(" ")
        for _ in range(rng.randrange(0, 3)):
            parts[rng.randrange(len(parts))] = f"new{rng.randrange(99)}"
        out.append((i, " ".join(parts), "en", "s0", 1))
    return out


@pytest.fixture(scope="module")
def odd():
    long = " ".join(["very", "long"] * 40_000)
    return [
        (1, None, "en", "a", 0), (2, "", None, None, None), (3, " \t\n ", "en", "a", 3), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3),
        (None, "no id here at all\nsame line of text", "en", "b", 1), (5, "same line of text\n\nsame line of text", "de", "b", 1), (5, "other words", "de", "b", 1),
        (6, long, "en", "c", 1), (7, long, "en", "c", 1), (8, "ünï cödé tèxt ß " * 3, "fr", None, 1),
    ]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    clash = ["kept", "copy", "shard", "n_words", "component_id", "contaminated", "license", "evidence"]
    return df.select("*", *(F.lit("x").alias(c) for c in clash)) if extra else df


OPERATORS = {
    "lines": line_dedup.line_dedup,
    "near": near_dup.near_dup,
    "model": lambda d: quality_model.quality_verdicts(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality"))),
    "rules": quality_rules.quality_rules,
    "lm": lambda d: lm_score.lm_score(d, rounds=1),
    "license": license_scan.license_scan,
    "leaks": lambda d: decontaminate.decontaminate(d, d.where("doc_id is null or doc_id < 6").select(F.col("doc_id").alias("item_id"), "text")),
    "shards": sharding.shard,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, odd, name):
    out = OPERATORS[name](frame(spark, odd)).select("doc_id").collect()
    assert Counter(r[0] for r in out) == Counter(r[0] for r in odd)
    assert OPERATORS[name](frame(spark, [])).count() == 0


def test_odd_rows_have_defined_values(spark, odd):
    """What each operator says of nulls, empty and long texts, repeated rows and ids."""
    df = frame(spark, odd)
    by = lambda out, *cols: Counter(tuple(r[c] for c in ("doc_id", *cols)) for r in out.collect())
    got = by(near_dup.near_dup(df), "n_shingles", "component_id", "kept")
    assert got == Counter({(1, 0, 1, True): 1, (2, 0, 2, True): 1, (3, 0, 3, True): 1, (4, 1, 4, True): 2, (None, 5, None, True): 1, (5, 4, 5, True): 1, (5, 1, 5, True): 1, (6, 2, 6, True): 1, (7, 2, 6, False): 1, (8, 4, 8, True): 1})
    got = by(quality_rules.quality_rules(df), "n_words", "base_failed", "kept")
    assert got == Counter({(1, 0, True, False): 1, (2, 0, True, False): 1, (3, 0, True, False): 1, (4, 1, True, False): 2, (None, 9, True, False): 1, (5, 8, True, False): 1, (5, 2, True, False): 1, (6, 80_000, True, False): 1, (7, 80_000, True, False): 1, (8, 12, True, False): 1})
    got = lm_score.lm_score(df).collect()
    assert {(r.doc_id, r.n_words) for r in got if r.n_words == 0} == {(1, 0), (2, 0), (3, 0)} and all((r.per_word is None) == (r.n_words == 0) and r.log_likelihood <= 0 for r in got)
    assert len({r.log_likelihood for r in got if r.doc_id == 4}) == 1
    got = by(license_scan.license_scan(df), "license")
    assert set(got) == {(r[0], None) for r in odd}
    items = spark.createDataFrame([(1, None), (2, ""), (3, "same line of text")], "item_id long, text string")
    got = by(decontaminate.decontaminate(df, items), "contaminated", "n_items")
    assert got == Counter({(1, False, 0): 1, (2, False, 0): 1, (3, False, 0): 1, (4, False, 0): 2, (None, True, 1): 1, (5, True, 1): 2, (6, False, 0): 1, (7, False, 0): 1, (8, False, 0): 1})
    assert not any(r.contaminated for r in decontaminate.decontaminate(df, items.limit(0)).collect())
    got = sharding.shard(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in odd)


def test_columns_of_clashing_names_pass_through(spark, rows):
    clash = ["copy", "shard", "slot", "n", "w", "h", "p", "good", "evidence", "of", "host", "path", "kept", "_u", "_t", "_s", "_k", "_cdf", "_h", "_p", "_part", "_at", "_key", "_gone", "hits", "row", "place"]
    df = frame(spark, rows, extra=False).select("*", *(F.lit(f"mine {c}").alias(c) for c in clash))
    mine = [c for c in clash if c != "copy"]
    same = lambda out, cols: all(r[c] == f"mine {c}" for r in out.select(*cols).collect() for c in cols)
    assert same(mixing.mix(df), mine)
    labels = df.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    kept = quality_model.quality_classifier(df, labels)
    assert kept.columns == df.columns and same(kept, clash)
    clean = decontaminate.without_contaminated(df, df.limit(3).select(F.col("doc_id").alias("item_id"), "text"))
    assert clean.columns == df.columns and same(clean, clash)
    placed = sharding.shard(df, texts=True)
    assert same(placed, [c for c in mine if c not in ("shard", "slot")]) and placed.count() == len(rows)
    assert lm_score.lm_score(df).count() == near_dup.near_dup(df).count() == line_dedup.line_dedup(df).count() == len(rows)


def test_odd_mixing_and_pages(spark, odd):
    out = mixing.mix(frame(spark, odd), epochs=3.0)
    assert set(out.columns) == set(frame(spark, odd).columns)
    counts = Counter((r.doc_id, r.text) for r in out.collect())
    assert counts[4, "one"] % 2 == 0  # repeated rows share a count
    assert mixing.mix(frame(spark, [])).count() == 0
    pages = [(1, "u", None), (2, "u", ""), (2, "u", ""), (None, None, "x"), (3, "u", "x"), (3, "v", "y" * 200_000), (4, "v", "y" * 200_000), (3, "v", "y" * 200_000)]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))).collect()
    assert Counter(r.page_id for r in got) == Counter(p[0] for p in pages)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_lines_by_brute_force(spark, rows, odd):
    docs = [(d, t) for d, t, *_ in odd + [(r[0] + 100, r[1] + "\nA  shared LINE of all \n x", *r[2:]) for r in rows]]
    key = lambda x: x.strip(SPACES).translate({c: c + 32 for c in range(65, 91)})
    for least in (2, 3):
        held = defaultdict(set)
        for d, t in docs:
            for x in (t or "").split("\n"):
                if d is not None and len(key(x)) >= 10:
                    held[key(x)].add(d)
        want = []
        for d, t in docs:
            lines = (t or "").split("\n")
            keep = [x for x in lines if d is None or len(h := held.get(key(x), ())) < least or min(h) == d]
            want.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
        got = line_dedup.line_dedup(spark.createDataFrame([(d, t) for d, t in docs], "doc_id long, text string"), min_docs=least).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_word_hashes_agree_with_strings():
    rng = random.Random(1)
    texts = ["", None, "a", "Ab aB\tab", prose(rng, 50_000), "x" * 300_000 + " y", "é\x0bÉ  é"]
    w = words(pa.array(texts))
    flat = [x.translate({c: c + 32 for c in range(65, 91)}) for t in texts for x in (t or "").translate(dict.fromkeys(map(ord, SPACES), " ")).split(" ") if x]
    assert len(flat) == len(w.hashes)
    assert len(set(flat)) == len(set(w.hashes.tolist())) == len(set(zip(flat, w.hashes.tolist(), strict=True)))
    values, offsets = shingles(w, 2)
    assert np.diff(offsets).tolist()[:3] == [0, 0, 1]


@pytest.mark.parametrize("size", [2, 5])
def test_near_dup_by_brute_force(spark, rows, size):
    sets = {}
    for d, t, *_ in rows:
        w = t.split()
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_dup(frame(spark, rows), size=size).collect()}
    assert got == {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def test_near_dup_hot_bucket_is_whole(spark):
    """A chain through many close variants of one text: no pair of a large bucket may be lost."""
    rng = random.Random(3)
    base = [f"t{i}" for i in range(60)]
    docs = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(60), rng.randrange(0, 4)):
            w[k] = f"z{i}_{k}"
        docs.append((i, " ".join(w), "en", "s", 1))
    test_near_dup_by_brute_force(spark, docs, 2)


@pytest.mark.parametrize("percent", [30, 50, 60, 80, 95, 100])
def test_bands_follow_the_threshold(percent):
    t = percent / 100
    rows, bands = near_dup.banding(t)
    assert rows * bands <= near_dup.MOST and (1 - t**rows) ** bands <= near_dup.BAND_MISS
    if percent == 80:
        assert (rows, bands) == (5, 36)
    steps = near_dup.least_matches(t, 1e-7, rows * bands)
    rng, lost = np.random.default_rng(0), 0
    for _ in range(2000):
        hits = rng.random(rows * bands) < t
        lost += any(hits[:n].sum() < least for n, least in steps)
    assert lost == 0
    with pytest.raises(ValueError):
        near_dup.banding(0.01)


def test_recall_of_near_copies(spark):
    """Copies with a twentieth of their words changed: every link at 60 % of two-word shingles is found."""
    rng, docs = random.Random(31), []
    for i in range(120):
        w = prose(rng, 150, 10**6).split()
        docs.append((2 * i, " ".join(w), "en", "s", 1))
        for k in rng.sample(range(150), 8):
            w[k] = f"x{k}"
        docs.append((2 * i + 1, " ".join(w), "en", "s", 1))
    got = {r.doc_id: r.component_id for r in near_dup.near_dup(frame(spark, docs), size=2, percent=60).collect()}
    grams = lambda t: {(x, y) for x, y in zip(t.split(), t.split()[1:], strict=False)}
    alike = [i for i in range(120) if 100 * len(grams(docs[2 * i][1]) & grams(docs[2 * i + 1][1])) >= 60 * len(grams(docs[2 * i][1]) | grams(docs[2 * i + 1][1]))]
    assert len(alike) > 100 and all(got[2 * i + 1] == 2 * i for i in alike)


def test_quality_rules_counts(spark, rows):
    docs = [*rows, (500, "#a |b| a\n\na\n  \na é", "en", "s9", 1), (501, "x y z a b c d e " * 9, "en", "s9", 1), (502, None, "en", None, 1)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, docs)).collect()}
    for d, t, *_ in docs:
        w = [x for x in (t or "").translate(dict.fromkeys(map(ord, SPACES), " ")).split(" ") if x]
        lines = [x for x in (t or "").split("\n") if x.strip(SPACES)]
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover))
        assert tuple(got[d][c] for c in quality_rules.COUNTS) == want
        assert got[d].base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
        assert not (got[d].kept and got[d].base_failed)


def test_bad_host_takes_good_documents(spark):
    good = " ".join(f"word{i}" for i in range(30))
    docs = [(i, good, "en", f"h{i % 20}", 1) for i in range(2000)] + [(5000 + i, "short" if i % 10 else good, "en", "bad", 1) for i in range(400)]
    got = quality_rules.quality_rules(frame(spark, docs)).groupBy("kept", "base_failed").count().collect()
    assert {(r.kept, r.base_failed): r["count"] for r in got} == {(True, False): 2000, (False, True): 360, (False, False): 40}


@pytest.mark.parametrize("bad", [" ".join(f"#w{i}" for i in range(30)), "\n".join(["same line here"] * 4 + [f"word{i}" for i in range(30)]), " ".join(chr(97 + i % 26) for i in range(29)) + " z1 z2"])
def test_bad_host_by_every_count(spark, bad):
    """Symbols, repeated lines and odd words don't fail a document, but a host that is full of them."""
    good = " ".join(f"word{i}" for i in range(30))
    docs = [(i, bad if i % 40 == 0 else good, "en", f"h{i % 20}", 1) for i in range(2000)] + [(5000 + i, bad if i % 4 else good, "en", "bad", 1) for i in range(400)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, docs)).collect()}
    assert all(not r.base_failed and r.kept == (d < 5000) for d, r in got.items())


def test_quality_classifier_holds_out(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join((f"W{rng.randrange(99)}***" if bad else f"w{rng.randrange(999)}") for _ in range(60))
        docs.append((i, text, "en", f"s{i % 5}", 1))
        if i % 2 == 0:
            labels.append((i, int(not bad)))
    got = quality_model.quality_verdicts(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert sum(r.kept == (r.doc_id % 4 != 0) for r in got) >= 396
    assert all(0 < r.p_quality < 1 and 0 < r.path_rate < 1 for r in got)


def test_quality_by_plain_loops(spark):
    """Host and path posteriors around each document's evidence, document by document."""
    rng = random.Random(17)
    docs, labels = [], []
    for i in range(500):
        host, path = f"h{i % 7}", f"p{i % 3}"
        bad = rng.random() < {0: 0.7, 1: 0.1}.get(i % 7, 0.3) + (0.2 if i % 3 == 0 else 0)
        text = " ".join(rng.choice(["bad", "worse"]) if bad and rng.random() < 0.3 else f"w{rng.randrange(200)}" for _ in range(30))
        docs.append((i, text, path if i % 50 else None, host if i % 60 else None, 1))
        labels.append((i, int(not bad)))
    docs += [docs[3], (600, None, "p1", "h1", 1), (601, "", "p1", "alone", 1), (None, "w1 w2", "p1", "h1", 1)]
    df, given = frame(spark, docs), spark.createDataFrame(labels[:250], "doc_id long, quality int")
    got = quality_model.quality_verdicts(df, given).collect()
    assert sum(r.kept == bool(labels[r.doc_id][1]) for r in got if r.doc_id is not None and 250 <= r.doc_id < 500) >= 225  # held out
    p = [1 / (1 + np.exp(-r.evidence)) for r in got]
    hosts, paths = defaultdict(list), defaultdict(list)
    for r, x in zip(got, p, strict=True):
        hosts[r.host].append(x)
        paths[r.host, r.path].append(x)
    mean = sum(p) / len(p)

    def weight(groups, centre):
        between = sum(len(x) * (np.mean(x) - centre(k)) ** 2 - (np.var(x, ddof=1) if len(x) > 1 else 0) for k, x in groups.items()) / len(p)
        return min(1e6, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e6

    of_host, of_path = weight(hosts, lambda _: mean), weight(paths, lambda k: np.mean(hosts[k[0]]))
    for r, x in zip(got, p, strict=True):
        h, q = hosts[r.host], paths[r.host, r.path]
        host = (sum(h) - x + mean * of_host) / (len(h) - 1 + of_host)
        path = (sum(q) - x + host * of_path) / (len(q) - 1 + of_path)
        odds = r.evidence + np.log(path / (1 - path)) - np.log(mean / (1 - mean))
        assert np.allclose((r.host_rate, r.path_rate, r.p_quality), (host, path, 1 / (1 + np.exp(-odds))), rtol=1e-6, atol=1e-9)
        assert r.kept == (r.p_quality >= 0.5)
    kept = quality_model.quality_classifier(df, given)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((d, t) for d, t, *_ in docs if next(r.kept for r in got if r.doc_id == d))


def test_quality_without_labels_keeps_all(spark, odd):
    df = frame(spark, odd)
    got = quality_model.quality_verdicts(df, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert all(r.kept and r.evidence == 0 for r in got) and len(got) == len(odd)


def test_lm_gradient_and_normalisation():
    rng = np.random.default_rng(2)
    flat = rng.normal(0, 0.3, len(lm_score.start())).astype(np.float32)
    p = lm_score.views(flat)
    around = rng.integers(0, lm_score.VOCABULARY, (4, 3)).astype(np.int32)
    each = [np.exp(lm_score.log_probabilities(p, around, np.full(3, y))) for y in range(lm_score.VOCABULARY)]
    assert np.allclose(np.sum(each, axis=0), 1, atol=1e-4)
    y = rng.integers(0, lm_score.VOCABULARY, 3)
    before = lm_score.log_probabilities(p, around, y).sum()
    square = lm_score.views(np.full(len(flat), 1e-2, np.float32))
    for _ in range(20):
        lm_score.train_step(p, square, around, y, 0.05)
    assert lm_score.log_probabilities(p, around, y).sum() > before + 1


def test_lm_windows_stay_in_their_text():
    ids, first = np.array([5, 6, 7, 8]), np.array([0, 3, 3, 4])
    assert lm_score.windows(ids, first).tolist() == [[0, 5, 6, 0], [0, 0, 5, 0], [6, 7, 0, 0], [7, 0, 0, 0]]


def test_lm_prefers_its_language(spark):
    rng = random.Random(6)
    docs = [(i, " ".join("the cat sat on a mat".split() * 8), "en", "s", 1) for i in range(150)] + [(900, " ".join(rng.sample("the cat sat on a mat".split() * 8, 48)), "en", "s", 1)]
    got = {r.doc_id: r.per_word for r in lm_score.lm_score(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got[0] > got[900] + 0.5


@pytest.mark.parametrize("head", [1 << 18, 5])
def test_lm_scores_by_plain_loops(spark, monkeypatch, head):
    """Word by word: the network's probability, and for rare words what the rest of the corpus has, or letters."""
    monkeypatch.setattr(lm_score.frequent_first, "__defaults__", (head,))
    rng = random.Random(15)
    common = [f"c{i}" for i in range(lm_score.VOCABULARY - lm_score.BUCKETS - 1)]
    docs = [(i, " ".join(common), "en", "s", 1) for i in range(40)]
    docs += [(100 + i, " ".join(rng.choice([rng.choice(common), f"Rare{rng.randrange(60)}", f"\u00e9{i}x"]) for _ in range(40)), "en", "s", 1) for i in range(30)]
    docs += [(200, docs[40][1], "en", "s", 1), (201, "twice twice twice", "en", "s", 1), (202, "", "en", "s", 1), (203, None, "en", "s", 1)]
    df = spark.createDataFrame(docs, SCHEMA)
    model = lm_score.fit(df)
    held = [(300, f"c1 nobody Rare1 c2 {docs[41][1]}", "en", "s", 1), (301, "c3 c4 qqq", "en", "s", 1)]
    got = {r.doc_id: r for r in lm_score.score(df, model, own=True).collect()} | {r.doc_id: r for r in lm_score.score(spark.createDataFrame(held, SCHEMA), model).collect()}

    low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
    counts = Counter(w for _, t, *_ in docs for w in low(t))
    pairs = Counter()
    for w, n in counts.items():
        x = b" " + w.encode() + b" "
        for q in zip(x, x[1:], strict=False):
            pairs[q] += n
    first = Counter()
    for (x, _), n in pairs.items():
        first[x] += n
    one = lambda w: words(pa.array([w])).hashes[0]
    frequent = {w for w in counts if int(one(w).view(np.int64)) in set(model.frequent)}
    assert set(common) <= frequent and len(frequent) == len(common)
    bucket = lambda w: int(one(w) % np.uint64(lm_score.BUCKETS))
    sizes = Counter()
    for w, n in counts.items():
        if w not in frequent:
            sizes[bucket(w)] += n
    unseen = max(1.0, sum(n == 1 for n in counts.values()) / lm_score.BUCKETS)
    p, tokens = lm_score.views(model.weights), lm_score.Tokens(model.frequent)
    for d, t, *_ in docs + held:
        w = low(t)
        h = words(pa.array([t or ""]))
        ids = tokens(h.hashes)
        net = lm_score.log_probabilities(p, lm_score.windows(ids, h.first), ids)
        mine = Counter(w) if d < 300 else Counter()
        want = 0.0
        for x, log in zip(w, net, strict=True):
            want += log
            if x not in frequent:
                b = b" " + x.encode() + b" "
                spelled = sum(np.log((pairs[q] + 0.1) / (first[q[0]] + 25.6)) for q in zip(b, b[1:], strict=False))
                others = sum(n for y, n in mine.items() if y not in frequent and bucket(y) == bucket(x))
                want += np.log((counts[x] - mine[x] + unseen * lm_score.BUCKETS * np.exp(spelled)) / (sizes[bucket(x)] - others + unseen))
        assert got[d].n_words == len(w) and np.isclose(got[d].log_likelihood, want, rtol=1e-5, atol=1e-4)
        assert got[d].per_word is None if not w else np.isclose(got[d].per_word, want / len(w), rtol=1e-5)
    assert np.isclose(got[200].log_likelihood, got[100].log_likelihood)


def test_lm_puts_junk_and_shuffled_words_below_held_out_prose(spark):
    rng = random.Random(16)
    nouns, verbs = [f"n{i}oun" for i in range(300)], [f"ve{i}rb" for i in range(300)]
    line = lambda: " ".join(f"the {rng.choice(nouns)} has {rng.choice(verbs)} a {rng.choice(nouns)} ." for _ in range(12))
    model = lm_score.fit(spark.createDataFrame([(i, line(), "en", "s", 1) for i in range(600)], SCHEMA))
    held = []
    for i in range(20):
        w = line().split()
        held += [(i, " ".join(w), "en", "s", 1), (100 + i, " ".join(rng.sample(w, len(w))), "en", "s", 1)]
        held.append((200 + i, " ".join("".join(rng.choice("bcdfghjklmpqrtwxz") for _ in x) for x in w), "en", "s", 1))
    got = {r.doc_id: r.per_word for r in lm_score.score(spark.createDataFrame(held, SCHEMA), model).collect()}
    for i in range(20):
        assert got[i] > got[100 + i] + 0.3 and got[100 + i] > got[200 + i] + 3


@pytest.mark.parametrize("rounds", [1, 2, 3, 7])
def test_lm_training_masks_every_position_once(rounds):
    hashes = np.tile(np.arange(1000, dtype=np.uint64), 3)
    first, ids = np.array([0, 1000, 1000, 2000, 3000]), np.array([4, 5, 6, 7])
    turns = [lm_score.targets(hashes, first, ids, t, rounds, 7) for t in range(rounds)]
    assert np.sort(np.concatenate(turns)).tolist() == list(range(3000))
    if rounds > 1:  # copies of a text leave out other places
        assert set(turns[0][turns[0] < 1000]) != {x - 1000 for x in turns[0] if 1000 <= x < 2000}


def test_lm_learns_from_every_place(spark):
    """A corpus of one word at one place trains too."""
    docs = spark.createDataFrame([(i, "only", "en", "s", 1) for i in range(2)], SCHEMA)
    assert not np.array_equal(lm_score.fit(docs, rounds=1).weights, lm_score.start())


def test_patience_alignment():
    a, b = [9, 1, 2, 8, 3, 4, 5, 7], [1, 2, 3, 4, 5]
    assert [y for _, y in license_scan.patience(a, b)] == [0, 1, 2, 3, 4]
    rng = random.Random(8)
    for _ in range(300):
        x, y = [rng.randrange(12) for _ in range(20)], [rng.randrange(12) for _ in range(15)]
        pairs = license_scan.patience(x, y)
        assert all(x[i] == y[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_license_scan(spark):
    rng = random.Random(9)
    noise = prose(rng, 300)
    isc = license_scan.TEMPLATES["ISC"].split()
    edited = " ".join(w for i, w in enumerate(isc) if i % 17 != 3)
    docs = [
        (1, f"{noise} RELEASED under the MIT license. {noise}", "", "", 1), (2, noise, "", "", 1), (3, f"{noise}\n{edited}\n{noise}", "", "", 1),
        (4, "the the mit license released under under", "", "", 1), (5, f"Licensed under the Apache License, Version 2.0.\n{noise} Released under the MIT License.", "", "", 1),
    ]
    got = {r.doc_id: r for r in license_scan.license_scan(frame(spark, docs)).collect()}
    assert got[1].license == "MIT-notice" and (got[1].first_word, got[1].last_word) == (300, 304)
    assert got[2].license is None and got[4].license is None
    assert got[3].license == "ISC" and 0.9 < got[3].coverage < 1
    assert got[5].licenses == ["Apache-2.0-notice", "MIT-notice"]


def test_license_notice_twice_in_a_row(spark):
    rng = random.Random(10)
    notice, filler = "Licensed under the Apache License, Version 2.0", prose(rng, 40)
    docs = [(1, f"{filler} {notice} see file there {notice} {filler}", "", "", 1), (2, f"{filler} {notice} {notice} {notice} {filler}", "", "", 1)]
    got = {r.doc_id: r for r in license_scan.license_scan(frame(spark, docs)).collect()}
    assert all(got[i].license == "Apache-2.0-notice" and got[i].coverage == 1 for i in (1, 2))
    assert [got[i].last_word - got[i].first_word for i in (1, 2)] == [7, 7]


def _carried(text, template, coverage=0.8, stretch=1.5):
    """Whether any window of the text at all carries the template, and the most words aligned in one."""
    need, most = -(-len(template) * 4 // 5), 0
    for p in range(len(text)):
        for q in range(p + need, len(text) + 1):
            pairs = license_scan.patience(text[p:q], template)
            if len(pairs) >= need and pairs[-1][0] - pairs[0][0] + 1 <= stretch * len(pairs):
                most = max(most, len(pairs))
    return most


def test_license_over_all_windows(spark):
    """One to three copies, adjacent and apart, some words changed: against the alignment of every window of the text."""
    rng, docs, want = random.Random(18), [], {}
    templates = {"notice": "alpha under the beta license version two", "longer": " ".join(f"t{i % 23}" for i in range(30))}
    for i in range(60):
        name = rng.choice(list(templates))
        parts = [prose(rng, rng.randrange(8), 9)]
        for _ in range(rng.randrange(1, 4)):
            w = templates[name].split()
            for _ in range(rng.choice([0, 0, 1, len(w) // 6])):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["odd"], [w[k], "odd"]])
            parts += [" ".join(w), rng.choice(["", prose(rng, rng.randrange(6), 9)])]
        text = " ".join(x for x in parts if x)
        docs.append((i, text, "", "", 1))
        want[i] = {k: m for k, t in templates.items() if (m := _carried(text.split(), t.split()))}
    got = {r.doc_id: r for r in license_scan.license_scan(frame(spark, docs), templates).collect()}
    assert {i: set(r.licenses) for i, r in got.items()} == {i: set(m) for i, m in want.items()}
    best = {i: {k: max(round(x.coverage * len(templates[k].split())) for x in r.places if x.license == k) for k in r.licenses} for i, r in got.items()}
    assert sum(best[i] == want[i] for i in want) >= 58 and all(best[i][k] >= m - 1 for i, x in want.items() for k, m in x.items())


def test_license_copies_are_all_places(spark):
    rng = random.Random(19)
    noise = prose(rng, 30)
    docs, at = [], {}
    for i, (name, gap) in enumerate((n, g) for n in ("MIT-notice", "Apache-2.0-notice", "ISC", "MIT", "BSD-2-Clause", "GPL-2.0") for g in ("\n", " see there ", f" {noise} ")):
        text = license_scan.TEMPLATES[name]
        docs.append((i, gap.join([noise, text, text, text, noise]), "", "", 1))
        n = len(words(pa.array([text]), space=license_scan._SEPARATOR).hashes)
        skip = len(gap.split())
        at[i] = (name, [(30 + skip + k * (n + skip), 30 + skip + k * (n + skip) + n - 1) for k in range(3)])
    for r in license_scan.license_scan(frame(spark, docs)).collect():
        name, places = at[r.doc_id]
        assert [(x.first_word, x.last_word) for x in r.places if x.license == name] == places


def test_license_bodies(spark):
    rng = random.Random(13)
    names = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]
    docs = []
    for i, k in enumerate(names):
        edited = " ".join(w for j, w in enumerate(license_scan.TEMPLATES[k].split()) if j % 17 != 3)
        docs.append((i, f"{prose(rng, 100)}\n{edited}\n{prose(rng, 100)}", "", "", 1))
    got = {r.doc_id: r for r in license_scan.license_scan(frame(spark, docs)).collect()}
    assert all(k in got[i].licenses and got[i].coverage > 0.9 for i, k in enumerate(names))
    assert [got[i].license for i in (0, 4, 5, 6, 7)] == [names[i] for i in (0, 4, 5, 6, 7)]  # Apache-2.0 and MPL-2.0 hold their notices whole


def test_mixing_by_brute_force(spark, rows):
    weights = {"s0": 0.2, "s1": 0.5, "s2": 0.3}
    got = Counter(r.doc_id for r in mixing.mix(frame(spark, rows), weights=weights, epochs=4.0).collect())
    sizes = Counter(r[3] for r in rows)
    for d, _, _, s, _ in rows:
        rate = 4.0 * len(rows) * weights[s] / sizes[s]
        u = int(hashlib.md5(f"mix:{d}:1".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, np.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        assert got[d] == k
    large = mixing.mix(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a").alias("source")), epochs=1000.0).count()
    assert abs(large - 50_000) < 5 * 50_000**0.5


def test_decontamination(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, 40, 5000)) for i in range(20)] + [(98, None), (99, "too short")]
    docs = [(i, prose(rng, 300, 5000), "", "", 1) for i in range(60)]
    for i in range(20):
        w = items[i][1].split()
        for k in range(5, 40, 9):
            w[k] = "changed"
        docs.append((100 + i, f"{prose(rng, 50, 5000)}, {' '.join(w).upper()}! {prose(rng, 50, 5000)}", "", "", 1))
    got = decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id for r in got if r.contaminated} == set(range(100, 120))
    left = decontaminate.without_contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == set(range(60)) and left.columns == frame(spark, docs).columns


def test_decontamination_by_short_items_and_blind_pairs(spark):
    rng = random.Random(14)
    items = [(n, prose(rng, n, 10**9)) for n in range(1, 13)]
    docs = [(n, f"{prose(rng, 20)} {text.upper()}. {prose(rng, 20)}", "", "", 1) for n, text in items]
    for k in (2, 3):  # two changes that every place of the first two masks reads
        w = items[11][1].split()
        w[k] = w[k + 1] = "changed"
        docs.append((100 + k, f"{prose(rng, 20)} {' '.join(w)} {prose(rng, 20)}", "", "", 1))
    docs.append((200, prose(rng, 60), "", "", 1))
    got = decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.equal_words for r in got if r.contaminated} == {**{n: n for n in range(1, 13)}, 102: 10, 103: 10}


def test_sharding_law(spark, rows):
    got = sharding.shard(frame(spark, rows)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    text = {r[0]: r[1] for r in rows}
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    for source, n in Counter(r[3] for r in rows).items():
        assert all(abs(sum(r.source == source for r in s) - n / 24) < 2 for s in by.values())  # both cuts round


def test_copies_of_a_document_are_far_apart(spark):
    """Mixing, then sharding: the copies of one document come to different shards."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    copies = mixing.mix(docs, epochs=3.0).drop("copy")
    got = defaultdict(list)
    placed = sharding.shard(copies).collect()
    n = len(placed)
    for r in placed:
        got[r.doc_id].append(r.shard * n // 24 + r.slot)
    gaps = [b - a for x in got.values() for a, b in zip(sorted(x), sorted(x)[1:], strict=False)]
    assert len(gaps) > 4000 and min(gaps) > n // 200 and sorted(gaps)[len(gaps) // 2] > n // 10


def test_shards_are_written_with_their_texts(spark, rows, odd, tmp_path):
    df = frame(spark, rows + odd)
    sharding.write_shards(sharding.shard(df, texts=True), f"file://{tmp_path}/shards")
    got = spark.read.parquet(f"file://{tmp_path}/shards").collect()
    assert Counter((r.doc_id, r.text, r.lang) for r in got) == Counter((d, t, lang) for d, t, lang, *_ in rows + odd)
    plain = Counter((r.doc_id, r.shard, r.slot, r.size) for r in sharding.shard(df).collect())
    ours = Counter((r.doc_id, r.shard, r.slot, r.size) for r in got)
    assert ours == plain and {(r.shard, r.slot) for r in got} == {(s, k) for _, s, k, _ in plain}
    assert sharding.shard(frame(spark, []), texts=True).count() == 0


def test_warc_round_trip(spark):
    rng = random.Random(12)
    html = ["", "a", "ü" * 7, *("".join(chr(rng.randrange(32, 1000)) for _ in range(n)) for n in (5, 8191, 8192, 8193, 32_000, 70_000, 300_000))]
    pages = [(i, f"http://x/{i}", html[i % len(html)]) for i in range(25)]
    path = warc.stage_path(spark, "t")
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_warc(warc.write_warc(df, path, file_bytes=100_000), path).collect()}
    for i, url, text in pages:
        first = i % len(html)
        r = got[i]
        assert r.url == url and r.payload_bytes == len(text.encode()) and r.payload_digest == warc.sha1_base32(text.encode())
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
        assert r.payload is None if i != first else bytes(r.payload) == text.encode()


def test_warc_parses_plain_files_and_rejects_broken_frames():
    plain = b"".join(b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n" for b in (b"", b"ab\r\n\r\ncd", b"z" * 200_000))
    assert [len(b) for _, b in warc.parse(io.BytesIO(plain))] == [0, 8, 200_000]
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


def _tampered(spark, tmp_path, change):
    """A page of several segments, its records changed by ``change``, read back."""
    html = "".join(f"<p>{i}</p>" for i in range(20_000))
    path = f"file://{tmp_path}/warc"
    files = warc.write_warc(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), path)
    name = files.first().path
    with open(name, "rb") as f:
        records = list(warc.parse(f))
    assert len(records) > 3
    with open(name, "wb") as f:
        for fields, block in change(records):
            kind = fields.pop("warc-type")
            fields.pop("content-length")
            f.write(warc.record(kind, [(k, v) for k, v in fields.items()], block))
    return warc.read_warc(files, path)


@pytest.mark.parametrize("change", [
    lambda x: x[:2] + x[3:], lambda x: x[:-1], lambda x: [(f | ({"warc-segment-total-length": "7"} if "warc-segment-total-length" in f else {}), b) for f, b in x],
    lambda x: [(f, b.replace(b"<p>5</p>", b"<p>6</p>")) for f, b in x],
], ids=["segment lost", "end lost", "wrong total", "wrong digest"])
def test_warc_rejects_broken_archives(spark, tmp_path, change):
    with pytest.raises(Exception, match="segments missing|digest"):
        _tampered(spark, tmp_path, change).collect()


def test_warc_takes_segments_in_any_order(spark, tmp_path):
    got = _tampered(spark, tmp_path, lambda x: x[::-1]).collect()
    assert len(got) == 1 and got[0].payload.decode().endswith("<p>19999</p>")


def test_warc_record_ids_are_unique(spark, tmp_path):
    pages = [(1, "u", "a"), (1, "u", "a"), (2, "u", "a"), (2, "u", "a"), (3, "u", "b"), (4, "u", "b"), (None, "u", "b"), (None, "u", "b"), (5, "u", "z" * 70_000), (5, "u", "z" * 70_000)]
    files = warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    records = []
    for r in files.collect():
        with open(r.path, "rb") as f:
            records += [x for x, _ in warc.parse(f)]
    ids = [x["warc-record-id"] for x in records]
    assert len(ids) == len(set(ids)) and all(x["warc-refers-to"] in ids for x in records if "warc-refers-to" in x)
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read_warc(files, f"file://{tmp_path}/w").collect())
    assert got == Counter({(1, "response", None): 2, (2, "revisit", 1): 2, (3, "response", None): 1, (4, "revisit", 3): 1, (None, "response", None): 2, (5, "response", None): 2})


def test_decontamination_recall_by_substitutions(spark):
    """Every way to change two words of a 12-word item is seen; changes of a sixth of longer items nearly always."""
    from itertools import combinations

    rng, items, docs = random.Random(41), [], []
    base = [f"q{i}" for i in range(12)]
    items.append((0, " ".join(base)))
    for n, (i, j) in enumerate(combinations(range(12), 2)):
        w = list(base)
        w[i] = w[j] = "changed"
        docs.append((n, f"{prose(rng, 20)} {' '.join(w)} {prose(rng, 20)}", "", "", 1))
    for n in range(200):
        w = [f"r{n}_{i}" for i in range(20)]
        items.append((1 + n, " ".join(w)))
        for k in rng.sample(range(20), 3):
            w[k] = "changed"
        docs.append((1000 + n, f"{prose(rng, 20)} {' '.join(w)} {prose(rng, 20)}", "", "", 1))
    got = {r.doc_id: r.contaminated for r in decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum(got[n] for n in range(66)) == 66 and sum(got[1000 + n] for n in range(200)) >= 198
