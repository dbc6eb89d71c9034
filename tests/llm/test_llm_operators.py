"""Operators over training texts against brute force, and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vidlake.llm import (
    chat, decontam, jaccard, language, lines, packing, queries, shards, spots, substrings, urls,
)
from vidlake.llm.components import components
from vidlake.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path(queries.TOKENIZER)
SCHEMA = "doc_id long, text string, lang string, n_words long, shard string"
LONG = " ".join(f"w{k % 977}" for k in range(40_000))
ODD = [(1, None, "en", 7, "x"), (2, "", None, 7, "x"), (None, "Same line here\nno", "en", 7, None),
       (3, "Same line here \nyes", "de", 7, "x"), (3, "Same line here \nyes", "de", 7, "x"),
       (4, LONG, "en", 7, "x"), (5, " \t\n", "en", None, "x")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(params=["odd", "empty"])
def odd(spark, request):
    return spark.createDataFrame(ODD if request.param == "odd" else [], SCHEMA)


def test_encoder_equals_tokenizer():
    rng = random.Random(1)
    parts = [*"abAB'st  \n\n\t.,!$19éß×ñ  本😀|<", "<|endoftext|>", "'re", " the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(2000)]
    encoder, plain = Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    ids, at = encoder.encode(pa.array([*texts, None]))
    assert at[-1] == len(ids) == at[-2]
    for k, t in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t


def check_packing(rows, texts, sequence):
    plain, at = Tokenizer.from_file(TOKENIZER), {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= sequence
    want = []
    for doc, text in texts:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % sequence or min(sequence, len(ids))
        cuts = [0, *range(first, len(ids), sequence), len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((doc, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    least = -(-sum(w[3] for w in want) // sequence)
    return len(at), least


def test_packing(documents):
    rows = packing.packed(documents, TOKENIZER).collect()
    used, least = check_packing(rows, [(r.doc_id, r.text) for r in documents.collect()], 2048)
    assert used <= least + 2


def test_packing_odd(odd):
    rows = packing.packed(odd, TOKENIZER, sequence=64).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd.collect()], 64)


def test_crossover_keeps_every_piece():
    rng = random.Random(2)
    length = [rng.randrange(1, 90) for _ in range(300)]
    found = packing.evolved([], length, 100, 4, 20, rng)
    for bins in found:
        assert sorted(p for b in bins for p in b) == list(range(300))
        assert all(sum(length[p] for p in b) <= 100 for b in bins)
    first: list = []
    packing.best_fit(first, list(range(300)), length, 100)
    assert len(found[0]) <= len(first)


def test_language_held_out(spark):
    found = queries.op2_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = found.where("held_out").join(docs, "doc_id").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_language_odd(odd):
    rows = language.predicted(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert 0 <= r.score <= 1
        if not re.search("[a-z]", r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_fm_index():
    rng = np.random.default_rng(0)
    for _ in range(50):
        text = rng.integers(1, 5, rng.integers(3, 150))
        index = decontam.FMIndex(text)
        whole = np.append(text, 0).tolist()
        assert decontam.suffix_order(np.array(whole)).tolist() == sorted(
            range(len(whole)), key=lambda i: whole[i:])
        patterns = np.array([text[i:i + 3] for i in range(0, len(text) - 2, 5)])
        low, high = index.search(patterns, np.full(len(patterns), 3))
        for p, a, b in zip(patterns.tolist(), low, high, strict=True):
            want = [i for i in range(len(text) - 2) if text[i:i + 3].tolist() == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination_blocks_and_odd(spark, odd, documents, monkeypatch):
    benchmark = spark.createDataFrame(
        [(1, "Same LINE here"), (1, None), (None, "yes"), (3, ""), (4, LONG)],
        "item_id long, text string")
    once = decontam.spans(odd, benchmark).collect()
    monkeypatch.setattr(decontam, "PATTERN_BYTES", 1)
    assert sorted(decontam.spans(odd, benchmark).collect(), key=repr) == sorted(once, key=repr)
    for r in once:
        if r.doc_id == 3:
            assert (r.n_words, r.n_hit, r["items"]) == (4, 4, ["1", "null"])
        if r.doc_id == 4:
            assert r.n_hit == r.n_words == 40_000
    cut = {r.doc_id: r.text for r in decontam.cleaned(decontam.spans(odd, benchmark)).collect()}
    two, one = decontam.cleaned(decontam.spans(odd, benchmark)), decontam.without_passages(
        odd, benchmark)
    assert sorted(one.collect(), key=repr) == sorted(two.collect(), key=repr)
    assert one.columns == two.columns
    assert cut.get(3, "") == ""


def test_substrings_odd(odd):
    rows = substrings.drop_repeats(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.n_removed == 0 or r.doc_id == 4
        if r.doc_id == 4:  # all its windows occur again 977 words on
            assert (r.n_words, r.n_removed) == (40_000, 40_000)


def test_jaccard_dense_group(spark):
    """A group of near copies, many of them near the threshold, against brute force."""
    rng = random.Random(5)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for d in range(150):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(60)}"
        rows.append((d, " ".join(words[:rng.randrange(112, 121)])))
    rows += [(900, "one"), (901, "ONE"), (902, "one two"), (903, None), (None, rows[0][1])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {}
    for d, t in rows[:-1]:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[k:k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
    low = {d: d for d in sets}
    for _ in range(len(sets)):
        before = dict(low)
        for a in sets:
            for b in sets:
                c = len(sets[a] & sets[b])
                if c and 100 * c >= 90 * (len(sets[a]) + len(sets[b]) - c):
                    low[a] = min(low[a], low[b])
        if low == before:
            break
    assert got.pop(None)[1] is None
    assert got == {d: (len(s), low[d]) for d, s in sets.items()}


def test_jaccard_odd(odd):
    rows = jaccard.linked(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.component_id == r.doc_id for r in rows)


def test_components(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(1, 900), (900, 7), (50, 50)]
    got = {r.id: r.component for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, 1: 1, 900: 1, 7: 1}


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, 1, "a", "search", '{"turn":1, "text":"x"}'), (1, 3, "b", "lookup", '{"text":"y","after":"$a"}'),
        (1, 4, "c", "count", '{"turn":"4"}'), (1, 5, "d", "lookup", '{"text":"z","after":"$d"}'),
        (1, 6, "e", "search", "no json"), (1, 7, None, "search", None),
    ], "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 2, "a", "ok"), (1, 2, "z", "lost")],
                                    "conv_id long, turn long, call_id string, content string")
    rows = {r.call_id: r for r in chat.linked(calls, results, queries.TOOLS).collect()}
    assert {k: (r.depth, r.status) for k, r in rows.items()} == {
        "a": (0, "done"), "b": (1, "open"), "c": (0, "invalid"), "d": (None, "circular"),
        "e": (0, "invalid"), None: (0, "invalid"), "z": (None, "orphan")}
    assert rows["a"].json == (
        '{"arguments":{"text":"x","turn":1},"depth":0,"id":"a","name":"search","problems":[],'
        '"result":"ok","status":"done"}')
    assert rows["c"].problems == ["turn is no number"]
    assert chat.linked(calls.limit(0), results.limit(0), queries.TOOLS).count() == 0


def test_lines_odd(odd):
    rows = lines.drop_shared_lines(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id is None:
            assert (r.text, r.n_lines, r.n_dropped) == ("no", 2, 1)
        if r.doc_id in (1, 2, 3):
            assert r.n_dropped == 0
    assert {r.text for r in rows if r.doc_id == 1} <= {None}


def test_url_rules_blocks(spark, monkeypatch):
    pages = spark.createDataFrame([
        (1, "http://A.example.org/es/1?x", "h"), (2, "https://example.org/en/12", "h"),
        (3, "http://spam-farm.example.net/", "h"), (4, None, "h"), (5, "no", "h"),
        (6, "http://x.com/de/", "h"), (7, "http://badexample.org", "h"), (7, "http://x.org/a", "h"),
    ], "page_id long, url string, HOST string")
    want = {(1, "example.org/es/", "block"), (2, "example.org/en/1", "block"), (3, None, "block"),
            (4, None, "allow"), (5, None, "allow"), (6, "com/de/", "block"), (7, None, "allow"),
            (7, "org/", "allow")}
    for block in (256, 2):
        monkeypatch.setattr(urls, "BLOCK", block)
        rows = urls.judged(pages, queries.URL_RULES).collect()
        assert {(r.page_id, r.rule, r.verdict) for r in rows} == want
    assert urls.judged(pages.limit(0), queries.URL_RULES).count() == 0


def test_spot_signatures(documents):
    rows = sorted(((r.doc_id, r.text or "") for r in documents.collect()), reverse=True)
    got = {r.doc_id: r for r in spots.edited_pairs(documents).collect()}
    prints = {r.doc_id: r.fingerprint for r in spots.fingerprints(documents).collect()}
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)][1], len(t) // 3
        r = got[d]
        assert r.edited_text == t[:len(t) - n] + after[:n]
        assert r.fingerprint == prints[d]
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.9 * len(got)


def test_spot_signatures_odd(odd):
    rows = spots.edited_pairs(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.fingerprint == "" for r in rows if r.doc_id in (1, 2, 5))


def test_shards(documents, odd):
    rows = queries.op10_byte_shards(documents.sparkSession, SF).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    total = sum(len(t) + 8 for t in texts.values())
    bytes_, slots = [0] * 24, [[] for _ in range(24)]
    for r in rows:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]))
        bytes_[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    longest = max(len(t) + 8 for t in texts.values())
    assert all(abs(b - total / 24) <= longest for b in bytes_)
    order = [r.shard for r in sorted(rows, key=lambda r: r.doc_id)]
    assert order == sorted(order)
    assert shards.sharded(odd, 3).count() == shards.byte_shards(odd, 3).count() == odd.count()


def test_pipeline(spark, documents):
    import corpus_pipeline as p

    docs = documents
    for _, step in p.STAGES[:-1]:
        out = step(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    # Brute force on the same stages' rules: what is left has no near copies and no passages.
    found = decontam.spans(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = p.run(spark, SF).collect()
    used, least = check_packing(rows, texts, 2048)
    assert used <= least + 2
    assert found.where("n_hit > 0").count() <= 0.01 * len(texts)
    assert len(hashlib.sha256(repr(texts).encode()).hexdigest()) == 64
