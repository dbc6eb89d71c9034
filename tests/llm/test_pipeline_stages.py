"""Stages of the corpus pipeline on planted cases."""

from __future__ import annotations

import random
import re
import zlib

import corpus_pipeline as p
import pyarrow as pa
import pytest

from vidlake.llm import language

SF = "/root/testdata/sf0.01"


def shingles(text, size=5):
    w = text.split()
    return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)}


def test_near_duplicates_between_the_bounds(spark):
    """Copies with a tail, and with one changed word: alike by 5 words, not by 3 words and 90."""
    rows, copies = [], set()
    for d in range(20):
        words = [f"d{d}w{k}" for k in range(50 + d % 9)]
        if d % 2:
            copy = [*words[:25], "changed", *words[26:]]
        else:
            copy = [*words, *(f"t{d}w{k}" for k in range(len(words) * (12 + d % 10) // 100))]
        rows += [(d, " ".join(words)), (100 + d, " ".join(copy))]
        x, y = shingles(rows[-2][1]), shingles(rows[-1][1])
        if len(x & y) >= 0.8 * len(x | y):
            copies.add(100 + d)
    assert len(copies) == 20
    docs = spark.createDataFrame([*rows, (200, " ".join(f"d1w{k}" for k in range(30)))],
                                 "doc_id long, text string")
    kept = {r.doc_id for r in p.near_duplicates(spark, docs, "").collect()}
    assert kept == {*range(20), 200}


NOISE = ["qxj zvk xqz jjk vvq kzx wqj " * 9, "0x3f a9 7c 11 22 zq qz 8f 9b " * 9]


def test_language_scores_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = spark.createDataFrame([(10**9 + k, t) for k, t in enumerate([*NOISE, "123 456", None])],
                                  "doc_id long, text string")
    every = docs.unionByName(noise, allowMissingColumns=True).select(*docs.columns)
    kept = {r.doc_id for r in p.languages(spark, every, SF).collect()}
    rows = [r for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    assert not [d for d in kept if d >= 10**9]
    assert len([r for r in rows if r.doc_id not in kept]) <= 0.005 * len(rows)


@pytest.mark.parametrize("long", [False, True])
def test_language_without_a_model_keeps_letters(spark, long):
    text = " ".join(f"word{k}" for k in range(3000)) if long else "Same old text."
    rows = [(k, f"{text} {k}", "en" if long else None) for k in range(8)]
    docs = spark.createDataFrame([*rows, (8, "123", None), (9, None, "en"), (10, "ж", None)],
                                 "doc_id long, text string, lang string")
    assert {r.doc_id for r in p.languages(spark, docs, SF).collect()} == {*range(8), 10}


def plain_language(rows, model):
    score = {}
    for d, text, _ in rows:
        if text and re.search("[a-z]", text, re.I):
            out = model.scores(pa.array([text]))[0]
            score[d, text] = (model.labels[out.argmax()],
                              min(max((float(out.max()) + 1) / 2, 0), 1))
    right = sorted(score[d, t][1] for d, t, lang in rows if (d, t) in score
                   and zlib.crc32(str(d).encode()) % 3 == 1 and score[d, t][0] == lang)
    assert 0 < len(right) < 1000  # so the bound is the least of them
    return [r for r in rows if r[:2] in score and score[r[:2]][1] >= right[0] - 1e-6]


def plain_lines(rows):
    key = lambda line: line.strip(" \t\r").lower()
    first = {}
    for d, text, _ in rows:
        for line in text.split("\n"):
            first[key(line)] = min(d, first.get(key(line), d))
    return [(d, "\n".join(x for x in text.split("\n") if len(key(x)) < 10 or first[key(x)] == d),
             lang) for d, text, lang in rows]


def plain_near(rows):
    sets = {d: shingles(text.lower()) or {tuple(text.lower().split())} - {()} for d, text, _ in rows}
    least, before = {d: d for d in sets}, None
    while before != least:
        before = dict(least)
        for a, x in sets.items():
            for b, y in sets.items():
                if x & y and 100 * len(x & y) >= 80 * len(x | y):
                    least[a] = min(least[a], least[b])
    return [r for r in rows if least[r[0]] == r[0]]


def plain_passages(rows, items, window=10):
    words = lambda t: [w.group().lower() for w in re.finditer("[0-9A-Za-z]+", t)]
    grams = {tuple(w[k:k + min(window, len(w))]) for w in map(words, items) if w
             for k in range(max(1, len(w) - window + 1))}
    out = []
    for d, text, lang in rows:
        at, w = list(re.finditer("[0-9A-Za-z]+", text)), words(text)
        hit = {p for g in grams for k in range(len(w) - len(g) + 1)
               if tuple(w[k:k + len(g)]) == g for p in range(k, k + len(g))}
        for k in sorted(hit, reverse=True):  # the last word of a run, then back to its first
            if k + 1 not in hit:
                end = at[k].end()
            if k - 1 not in hit:
                text = text[:at[k].start()] + " " + text[end:]
        out.append((d, text, lang))
    return out


def test_stages_equal_plain_python(spark, tmp_path):
    rng = random.Random(8)
    english = "the of and house garden river old green people walk under light morning".split()
    german = "der die und haus garten fluss alte leute gehen unter licht morgen strasse".split()
    items = [" ".join(f"q{k}item{j}" for j in range(14)) for k in range(4)] + ["Two words", None]
    rows = []
    for d in range(90):
        words = [rng.choice(german if d % 2 else english) + rng.choice(["", "", "n", "s"])
                 for _ in range(60)]
        lines = [" ".join(words[k:k + 12]) for k in range(0, 60, 12)]
        if d % 9 == 0:
            lines.insert(2, "  This line is SHARED by many " if d % 2 else "this line is shared by many")
        if d % 7 == 0:
            lines[3] += f", {items[d % 4][:-len('q0item13')]} {items[d % 4]}; two WORDS here"
        rows.append((d, "\n".join(lines), "de" if d % 2 else "en"))
    for d in range(0, 90, 6):  # near copies on one line, alike by 5 words and not by 3 words and 90
        words = rows[d][1].split()
        changed = [*words[:30], f"other{d}", *words[31:]]
        more = [*words, *(f"new{d}x{k}" for k in range(10))]
        rows.append((200 + d, " ".join(changed if d % 4 else more), rows[d][2]))
    rows += [(500 + k, t, None) for k, t in enumerate([*NOISE, "123", "", None])]
    schema = "doc_id long, text string, lang string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = language.fitted(language.sample(docs))
    plain = [lambda r: plain_language(r, model), plain_lines, plain_near,
             lambda r: plain_passages(r, [t for t in items if t])]
    want, sizes = rows, []
    for (name, step), check in zip(p.STAGES[:-1], plain, strict=True):
        found = step(spark, docs, str(tmp_path))
        before, want = want, check(want)
        got = sorted(tuple(r) for r in found.collect())
        assert got == sorted(want), name
        assert sorted(want, key=repr) != sorted(before, key=repr), name  # each stage has work
        sizes.append(len(want))
        docs = spark.createDataFrame(want, schema)
    assert sizes[0] <= 105 and sizes[2] <= sizes[1] - 10 and sizes[3] == sizes[2]
    packed = p.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r[0] for r in want}
