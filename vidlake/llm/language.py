"""The language of a text, by string kernels over landmark texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidlake.llm.columns import schema_with, without
from vidlake.llm.sent import send
from vidlake.llm.words import chunks

#: Bounds of the training sample: labels (the most frequent ones), different texts for each
#: label, and bytes of a text. The sample, and so the model, has this size for any corpus.
LABELS, PER_LABEL, TEXT_BYTES = 256, 300, 20_000
#: Landmark texts for each label; weight of the ridge.
LANDMARKS, RIDGE = 32, 0.1
#: Longest sequence of bytes in the blended spectrum.
GRAMS = 3
UNKNOWN = "und"
#: Of held-out texts whose label the model finds, so many may score below the bound.
LOST = 0.001
#: Texts that are scored in one matrix product.
ROWS = 512

_ALL = np.arange(256)
#: Letters of a text: 0 for ASCII that is no letter, 1 to 26 for a to z in either case, then
#: every byte of a character beyond ASCII as it is.
_LETTERS = np.select(
    [_ALL >= 0x80, (_ALL >= 0x61) & (_ALL <= 0x7A), (_ALL >= 0x41) & (_ALL <= 0x5A)],
    [_ALL - 0x80 + 27, _ALL - 0x60, _ALL - 0x40], 0).astype(np.int32)
_BASE = 155
#: Code of the first sequence of each length.
_FIRST = (0, _BASE, _BASE + _BASE ** 2)
_CODES = _FIRST[2] + _BASE ** 3

_LETTER = regex.compile(r"\p{L}")


def _codes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of sequence: the text and the code of every place that has one."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    offset = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offset[0]:offset[-1]] if buffer else np.zeros(0, np.uint8)
    offset = (offset - offset[0]).astype(np.int64)
    lengths = np.diff(offset)
    letters = _LETTERS[data]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    code = letters
    for n in range(GRAMS):
        if n:
            code = code[:-1] * _BASE + letters[n:]
        whole = doc[:len(code)] == doc[n:] if n else slice(None)
        yield doc[:len(code)][whole], code[whole] + _FIRST[n]


@dataclass
class Model:
    """Sequences known from the sample, landmarks as presence vectors over them, and a weight
    for each landmark and label."""

    labels: list[str]
    known: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    @cached_property
    def _column(self) -> np.ndarray:
        table = np.full(_CODES, len(self.known), np.int32)
        table[self.known] = np.arange(len(self.known))
        return table

    def presence(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: which known sequences it holds, scaled to length 1."""
        width = len(self.known) + 1  # the last column takes unknown ones
        held = np.zeros(len(texts) * width, np.uint8)
        for doc, code in _codes(texts):
            held[doc.astype(np.int64) * width + self._column[code]] = 1
        held = held.reshape(len(texts), width)[:, :-1].astype(np.float32)
        return held / np.sqrt(np.maximum(held.sum(axis=1, keepdims=True), 1))

    def scores(self, texts: pa.Array) -> np.ndarray:
        kernel = self.presence(texts) @ self.landmarks.T
        return np.hstack([kernel, np.ones((len(texts), 1), np.float32)]) @ self.weights


def fitted(sample: list[tuple[str, str]], landmarks: int = LANDMARKS,
           ridge: float = RIDGE) -> Model | None:
    """Kernel ridge regression, one label against the rest, in the space the landmarks span.
    `sample`: (label, text), each label's texts in random order. No sample gives no model."""
    if not sample:
        return None
    labels = sorted({label for label, _ in sample})
    texts = pa.array([t for _, t in sample], pa.string())
    known = np.unique(np.concatenate([np.unique(code) for _, code in _codes(texts)]))
    model = Model(labels, known, np.zeros((0, len(known)), np.float32), np.zeros((1, len(labels))))
    held = model.presence(texts)
    of = np.array([labels.index(label) for label, _ in sample])
    chosen = np.concatenate([np.flatnonzero(of == k)[:landmarks] for k in range(len(labels))])
    model.landmarks = held[chosen]
    among = (held[chosen] @ held[chosen].T).astype(np.float64)
    value, vector = np.linalg.eigh(among)
    good = value > 1e-6 * value.max(initial=1e-9)
    # Maps kernel values with the landmarks onto coordinates of the space they span.
    whiten = vector[:, good] / np.sqrt(value[good])
    z = np.hstack([(held @ held[chosen].T) @ whiten, np.ones((len(held), 1))])
    target = np.where(of[:, None] == np.arange(len(labels)), 1.0, -1.0)
    # Labels with few texts weigh as much as others.
    weight = (1 / np.bincount(of, minlength=len(labels)))[of][:, None] * len(of) / len(labels)
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    w = np.linalg.solve(z.T @ (weight * z) + penalty, z.T @ (weight * target))
    model.weights = np.vstack([whiten @ w[:-1], w[-1:]]).astype(np.float32)
    return model


def held_out() -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: int = LABELS, per_label: int = PER_LABEL,
           text_bytes: int = TEXT_BYTES) -> list[tuple[str, str]]:
    """Up to `per_label` different texts for each of the `labels` most frequent labels, from rows
    that have one and are not held out, chosen by a hash of the text. Copies of a text are
    reduced to one before they are shuffled."""
    rows = docs.where(F.col("lang").isNotNull() & ~held_out()
                      & F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= text_bytes))
    rows = rows.select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("_h"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("_h", 0.02).alias("n"))
    counts = counts.orderBy(F.desc("n"), "lang").limit(labels).collect()
    # Twice as many as wanted, so that chance and the rough count leave enough.
    shares = docs.sparkSession.createDataFrame(
        [(r["lang"], int(min(1.0, (2 * per_label + 50) / max(r["n"], 1)) * (1 << 40)))
         for r in counts], "lang string, _below long")
    rows = rows.join(F.broadcast(shares), "lang").where("_h < _below")
    found: dict[str, list] = {}
    for r in rows.groupBy("lang", "_h").agg(F.min("text").alias("text")).collect():
        found.setdefault(r["lang"], []).append((r["_h"], r["text"]))
    return [(lang, text) for lang in sorted(found)
            for _, text in sorted(found[lang])[:per_label]]


def score_bound(docs: DataFrame, model: Model, lost: float = LOST) -> float:
    """The score that all but a share of `lost` of the clean texts reach: those held-out rows
    whose label the model finds. The bound never exceeds the score of the share's last row, so
    few rows lose nothing (a millionth allows for other batches); without such rows it is 0.
    Nothing is shuffled."""
    rows = docs.where(F.col("lang").isNotNull() & held_out() & F.col("text").rlike(r"\p{L}"))
    right = predicted(rows.select("lang", "text"), model).where("lang = lang_pred")
    return (right.agg(F.percentile_approx("score", lost, 100_000)).first()[0] or 0.0) - 1e-6


def recognised(docs: DataFrame) -> DataFrame:
    """Documents with a letter whose text the classifier takes for one of the labelled languages:
    its score reaches `score_bound`. Text that resembles none of them goes. If there is nothing
    to learn from, no classifier can decide, and every text with a letter stays."""
    model = fitted(sample(docs))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    bound = score_bound(docs, model)
    known = predicted(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= bound))
    return known.select(*docs.columns)


def predicted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """`docs` with `lang_pred` and `score`.

    Texts are compared by the blended spectrum of their bytes: which sequences of 1 to 3 letters
    occur at all, among those known from the training sample. Kernel values with the landmark
    texts are one matrix product for some hundred texts, a second one gives each label's output
    (1 for it, -1 for the rest), and the greatest wins; `score` is that output moved from -1..1 to
    0..1. Only `text` enters a prediction. Nothing is shuffled but the sample.

    Without `model`, one is fitted on `sample(docs)`. Null texts, and texts without a letter, are
    `und` with score 0, as is everything if there was nothing to learn from. Repeated rows are
    judged alike; no rows give no rows. Other columns pass through; those called like a result
    are replaced.
    """
    if model is None:
        model = fitted(sample(docs))
    rows = without(docs, "lang_pred", "score")
    sent = send(rows.sparkSession, model)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for chunk in chunks(batches, "text"):
            for at in range(0, len(chunk), ROWS):
                batch = chunk.slice(at, ROWS)
                texts = batch.column(batch.schema.get_field_index("text"))
                letter = np.array([t is not None and _LETTER.search(t) is not None
                                   for t in texts.to_pylist()])
                lang, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
                if model is not None:
                    out = model.scores(texts)
                    best = out.argmax(axis=1)
                    score = np.clip((out.max(axis=1).astype(float) + 1) / 2, 0, 1) * letter
                    lang = [model.labels[b] if ok else UNKNOWN
                            for b, ok in zip(best, letter, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema_with(rows, lang_pred="string", score="double"))
