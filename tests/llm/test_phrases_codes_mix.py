"""Phrase mining, vector codes and source mixes against brute force, and odd inputs."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidlake.llm import codes, mixing, phrases

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n long, score string, up int"
WORDS = ["Zürich", "an", "b", "c", "d$", "the", "of", "日本"]


def prose(seed, n):
    """Texts with phrases that come again, over piece ends of every kind."""
    rng = random.Random(seed)
    gaps = [" ", "  ", "\t", " \t", ". ", ",", "\n", ";", ":\r\n", "! ?", "\x0b", " "]
    out = []
    for k in range(n):
        text = "".join(rng.choice(WORDS[:3] if rng.random() < .6 else WORDS)
                       + rng.choice(gaps[:4] if rng.random() < .8 else gaps) for _ in range(60))
        out.append((k, rng.choice([text, text.upper()]), rng.choice(["en", "de", None, "und"]),
                    "s", 1, "x", 0))
    return out


def mined(rows, least, inside, top):
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    count[lang or "und"][tuple(w[i:i + k])] += 1
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = collections.Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i:i + k]] = max(longer[p[i:i + k]], a)
        ranked = []
        for p, a in found.items():
            cut = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longer[p] < inside * a:
                ranked.append((-cut[0], -a, " ".join(p).encode(), f[p[:cut[1]]], f[p[cut[1]:]]))
        for n, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, n, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least, inside, top", [(2, 80, 2000), (5, 40, 7), (30, 80, 2000)])
def test_phrases_equal_brute_force(spark, least, inside, top, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 700)  # many blocks, and many ranges
    monkeypatch.setattr(phrases, "RANGE", 2000)
    rows = prose(3, 40)
    found = phrases.best(spark.createDataFrame(rows, SCHEMA).repartition(3), top, least, inside)
    want = mined(rows, least, inside, top)
    assert sorted(map(tuple, found.collect())) == want
    assert want


def test_phrases_odd(spark):
    rows = [(1, None, None, None, 1, "", 0), (2, "", "en", "s", 1, "", 0),
            (None, " .,\n", "en", "s", 1, "", 0)]
    rows += [(3, "a b " * 40_000, "en", "s", 1, "", 0)] * 2
    got = phrases.best(spark.createDataFrame(rows, SCHEMA), least=2)
    assert sorted(map(tuple, got.collect())) == mined(rows, 2, 80, 2000)
    assert phrases.best(spark.createDataFrame([], SCHEMA)).collect() == []


def test_nearest_equals_all_distances():
    rng = np.random.default_rng(4)
    for n, d, k, far in ((3000, 4, 64, 90), (1, 2, 1, 3), (50, 3, 5, 2), (900, 2, 33, 4)):
        points = np.concatenate((rng.integers(-far, far, (n, d)),
                                 rng.integers(-2, 2, (n // 2, d)) + 50 * far))
        entries = np.concatenate((points[rng.integers(0, n, k)], points[-1:]))
        levels = codes.depth(len(points), codes.LEAF)
        points = points[codes.tree_order(points, levels)]
        tree = codes.Tree.over(points, levels)
        want = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
        assert (codes.assigned(tree, entries) == want).all()
        total, count = codes.summed(tree, entries)
        assert (count == np.bincount(want, minlength=len(entries))).all()
        for e in range(len(entries)):
            assert (total[e] == points[want == e].sum(0)).all()
    # The distant half of the points, all of one entry, is never looked at singly.
    whole, single, _ = codes.nearest(tree, entries)
    assert whole and len(single) < len(points)


def plain_codes(rows, parts, entries, rounds):
    rows = sorted(((i, v, label) for i, v, label in rows if v and all(
        x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0], r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    x = np.array([[int(np.floor(256 * c)) for c in v] for _, v, _ in rows])
    x = x.reshape(len(x), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def near(p):
        return ((x[:, p, None] - books[p][None]) ** 2).sum(2)

    for _ in range(rounds):
        for p in range(parts):
            own = near(p).argmin(1)
            for e in set(own):
                books[p, e] = x[own == e, p].sum(0) // (own == e).sum()
    all_near = [near(p) for p in range(parts)]
    error = sum(m.min(1) for m in all_near)
    by = collections.Counter()
    for (_, _, label), e in zip(rows, error):
        by[label] += int(e)
    return sorted(((i, "".join(f"{m[k].argmin():02x}" for m in all_near), int(error[k]), by[label])
                   for k, (i, _, label) in enumerate(rows)), key=repr), books


@pytest.mark.parametrize("entries, rounds", [(64, 2), (5, 3), (1, 1)])
def test_codes_equal_brute_force(spark, entries, rounds, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 150)
    rng = np.random.default_rng(entries)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(0, .3, 8))],
             rng.choice([1, 2, None])) for i in rng.permutation(400)]
    rows += [rows[0]] * 30 + [(None, [.5] * 8, None), (-1, None, 3), (-2, [.1] * 7 + [None], 3),
                              (-3, [float("nan")] + [.1] * 7, 3), (-4, [], 1),
                              (7, [float("inf")] * 8, 1), (500, [.25] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    coded, books = codes.compressed(df.withColumn("error", F.lit("other")).repartition(3),
                                    4, entries, rounds)
    want, want_books = plain_codes(rows, 4, entries, rounds)
    got = codes.with_label_error(coded).select("vec_id", "code", "error", "label_error")
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert (books == want_books).all()


def test_codes_odd(spark):
    kind = "vec_id long, embedding array<double>, label int"
    for rows in ([], [(1, None, 1)]):
        coded, books = codes.compressed(spark.createDataFrame(rows, kind))
        assert codes.with_label_error(coded).collect() == [] and books.size == 0
    # Vectors shorter than their parts, of huge components, some of another length.
    rows = [(1, [1e300, -2.0], 1), (2, [-1e300, 0.0], None), (3, [0.0], 1)]
    coded, books = codes.compressed(spark.createDataFrame(rows, kind))
    got = {r.vec_id: r for r in coded.collect()}
    assert set(got) == {1, 2} and books.shape == (16, 2, 1)
    assert books[0].ravel().tolist() == [codes.bound(16), -codes.bound(16)]
    assert [got[1].error, got[2].error] == [0, 0]


def plain_targets(sizes):
    """Targets by sharing out, over and over, what is above twice a source's size."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / free for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def check_mix(rows, texts):
    size = [(d, len(re.findall("[^ \t-\r]+", t or "")), s) for d, t, s in texts]
    assert sorted([(r.doc_id, r.size, r.source) for r in rows], key=repr) == sorted(size, key=repr)
    sizes = collections.Counter()
    for _, n, s in size:
        sizes[s] += n
    want, taken = plain_targets(sizes), collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-12)
        rate = r.target / r.source_size if r.source_size else 1
        assert np.floor(rate) <= r.copies <= np.ceil(rate) <= 2 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    return {s: (taken[s], want[s]) for s in sizes}


def test_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    texts = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    for taken, target in check_mix(rows, texts).values():
        assert abs(taken - target) <= 0.02 * target
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


@pytest.mark.parametrize("fold", [8, mixing.FOLD])
def test_mix_of_many_is_exact_and_fair(spark, monkeypatch, fold):
    """With folds of 8, a tree of several levels: the words taken miss the target by less than
    one document, and each document is taken as often as wanted on average."""
    monkeypatch.setattr(mixing, "FOLD", fold)
    rng = random.Random(5)
    texts = [(k, "w " * rng.choice([1, 2, 3, 40, 900]), rng.choice("ab")) for k in range(1500)]
    schema = "doc_id long, text string, source string"
    rows = mixing.mix(spark.createDataFrame(texts, schema)).collect()
    for taken, target in check_mix(rows, texts).values():
        assert abs(taken - target) < 900
    rate = {r.source: r.target / r.source_size for r in rows}
    for source in "ab":
        for n in (1, 900):
            some = [r.copies for r in rows if (r.source, r.size) == (source, n)]
            assert abs(sum(some) / len(some) - rate[source]) < 0.12


def test_mix_odd(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)  # repeated rows of one unit by several tasks
    rows = [(1, None, None), (None, "a b", None), (2, "", "x"), (None, "c " * 50_000, "x")]
    rows += [(5, "one two three", "y")] * 100 + [(5, "other", "y"), (6, " \t", "only blanks")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows],
                               "doc_id long, text string, source string, size int, taken string")
    got = mixing.mix(df).collect()
    texts = [(d, t, s) for d, t, s in rows]
    check_mix(got, texts)
    written = collections.Counter((r.doc_id, r.text, r.source) for r in mixing.mixed(df).collect())
    times = collections.Counter()
    for r in got:
        times[r.doc_id, r.size, r.source] += r.copies
    assert collections.Counter({(d, len((t or "").split()), s): n for (d, t, s), n
                                in written.items() if n}) == +times
    assert mixing.mixed(df).columns == df.columns
    assert mixing.mix(df.limit(0)).collect() == []
