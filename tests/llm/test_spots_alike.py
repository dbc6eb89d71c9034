"""Spot signatures over whole tables against brute force."""

from __future__ import annotations

import random

import pyarrow as pa

from vidlake.llm import spots


def brute(rows, percent):
    """Pairs as `alike` shows them, every set compared with every other one."""
    own = spots.signatures(pa.array([t for _, t in rows], pa.string()))
    sets = {(d, frozenset(s.tolist())) for (d, _), s in zip(rows, own, strict=True)
            if d is not None and len(s)}
    least = {}
    for d, s in sets:
        least[s] = min(d, least.get(s, d))
    found = {(least[s], d, 1.0) for d, s in sets if d != least[s]}
    for x, a in least.items():
        for y, b in least.items():
            common = len(x & y)
            if a < b and 100 * common >= percent * len(x | y):
                found.add((a, b, common / len(x | y)))
    return found


def test_alike(spark):
    rng = random.Random(3)
    rows = []
    for d in range(40):
        words = [rng.choice(["the", "of", "and", f"w{rng.randrange(400)}"])
                 for _ in range(rng.choice([6, 30, 150, 600]))]
        rows.append((10 * d, " ".join(words)))
        for k in range(1, 4):  # near copies whose ids are far away
            words = list(words)
            for _ in range(1 + len(words) // 200):
                words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
            rows.append((10 * d + 1000 * k, " ".join(words + words[:k] * (len(words) // 40))))
    rows += [(5000, rows[0][1]), (5001, rows[0][1]), (None, rows[0][1]), (5002, None),
             (5003, " . "), (5004, "one"), (5005, "ONE")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (100, 80, 55):
        want = brute(rows, percent)
        assert len(want) > {100: 2, 80: 25, 55: 40}[percent]
        got = [tuple(r) for r in spots.alike(docs, percent).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert spots.alike(docs.limit(0)).count() == 0


def test_length_cuts_hold_alike_sets():
    for percent in (50, 70, 80, 97):
        cuts = spots.length_cuts(percent).tolist()
        for a in range(1, 400):
            for b in range(a, 100 * a // percent + 1):
                part = [sum(c <= n for c in cuts) for n in (a, b)]
                assert part[1] - part[0] <= 1


def near(*texts):
    x, y = spots.signatures(pa.array(texts, pa.string()))
    return spots.likeness(x, y)


def test_texts_without_common_words():
    """What follows the first three words counts in other languages, code and lists of numbers."""
    rng = random.Random(4)
    for n in (5, 8, 40, 3000):
        numbers = [[str(rng.randrange(10**6)) for _ in range(n)] for _ in range(2)]
        for x, y in (numbers, [[f"слово{w}" for w in t] for t in numbers]):
            assert near(" ".join(x), " ".join(x[:3] + y[3:])) < 1
    x, y = (" ".join(t) for t in numbers)
    assert near(x, "1 2 3 " + y) < 0.01
    assert 0.4 < near(x, x[:len(x) - len(x) // 3] + y[:len(x) // 3]) < 0.7
    changed = x.split()
    changed[1500] = "0"
    assert 0.99 < near(x, " ".join(changed)) < 1


def test_stretches_without_common_words():
    """Each word of a long stretch in a text with common words elsewhere counts, too."""
    words = "the cat of x".split() + [f"v{k}" for k in range(60)] + "and so on".split()
    for k in range(4, 64):
        changed = list(words)
        changed[k] = "other"
        assert 0.5 < near(" ".join(words), " ".join(changed)) < 1
    short = "the red house and one old garden by my big lake"  # no stretch is long: as before
    assert [len(s) for s in spots.signatures(pa.array([short, "one", "", None]))] == [4, 1, 0, 0]
