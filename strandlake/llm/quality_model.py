"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded: hashed byte pairs and some
ratios, through a layer of tanh units. Gated attention (Ilse et al., "Attention-based Deep Multiple Instance Learning", 2018)
gives each passage a weight, softmax over the bag of w . (tanh(V h) * sigmoid(U h)), and the score is a
logistic function of the weighted mean of the encodings. Labels are of whole documents; attention is learned from them.

The model is fitted by Adam on a sample of about ``FIT_DOCS`` labelled documents, drawn by a hash of doc_id; executors
turn their texts into passages' features, and those alone come to the driver, ``FIT_PASSAGES`` of a document at most,
evenly spread. Scoring takes every passage of every text.

Edge cases: a null or empty text is a bag of one empty passage; a null doc_id hashes like the empty text; with labels of one
kind only or none, every score is the share of label 1, or 0.5; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import require, table
from .lang_id import remainder

PASSAGE = 80
PAIRS = 192
RATIOS = 10
WIDTH = PAIRS + RATIOS
HIDDEN = 24
GATE = 12
FIT_DOCS = 4000
FIT_PASSAGES = 32
EPOCHS = 40
RATE = 0.01
DECAY = 1e-4


def kinds() -> np.ndarray:
    """For each byte: upper-case ASCII, lower-case ASCII, digit, symbol, other punctuation, beyond ASCII."""
    out = np.full(256, 4)
    out[65:91], out[97:123], out[48:58], out[128:] = 0, 1, 2, 5
    out[[ord(c) for c in "#*$%&|<>{}[]\\^~=_@"]] = 3
    return out


KINDS = kinds()


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text)."""
    passages, counts, ratios = [], [], []
    for text in texts:
        words = text.encode("utf-8").split()
        before = len(passages)
        for at in range(0, max(1, len(words)), PASSAGE):
            part = words[at : at + PASSAGE]
            passages.append(b" ".join(part))
            ratios.append((len(part), len(set(part)), len(set(zip(part, part[1:], strict=False)))))
        counts.append(len(passages) - before)
    sizes = np.array([len(p) for p in passages])
    whole = np.frombuffer(b" ".join(passages) + b" ", dtype=np.uint8)
    owner = np.repeat(np.arange(len(passages)), sizes + 1)
    pair = (whole[:-1].astype(np.int32) * 31 + whole[1:].astype(np.int32) * 17) % PAIRS
    pairs = np.bincount(owner[:-1] * PAIRS + pair, minlength=len(passages) * PAIRS).reshape(-1, PAIRS).astype(np.float32)
    pairs = np.sqrt(pairs / np.maximum(1, pairs.sum(axis=1, keepdims=True)))
    kind = np.bincount(owner * 6 + KINDS[whole], minlength=len(passages) * 6).reshape(-1, 6)
    n, distinct, distinct_pairs = np.array(ratios, dtype=np.float32).reshape(-1, 3).T
    full = np.maximum(1, sizes)[:, None]
    some = np.stack([distinct / np.maximum(1, n), distinct_pairs / np.maximum(1, n), n / PASSAGE, np.minimum(sizes / np.maximum(1, n), 30) / 10], axis=1)
    return np.concatenate([3 * pairs, 3 * kind / full, some], axis=1).astype(np.float32), np.array(counts)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """``w1, b1`` encode a passage, ``v, u, a`` are its gated attention, ``c, d`` score the weighted mean."""

    w1: np.ndarray
    b1: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray

    @staticmethod
    def fresh(rng: np.random.Generator, share: float = 0.5) -> Model:
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(draw(WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN, GATE), draw(HIDDEN, GATE), draw(GATE), draw(HIDDEN), np.array(np.log(share / (1 - share)), np.float32))

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple:
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        bag = np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(x @ self.w1 + self.b1)
        t, s = np.tanh(h @ self.v), sigmoid(h @ self.u)
        logit = (t * s) @ self.a
        e = np.exp(logit - np.maximum.reduceat(logit, starts)[bag])
        weight = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        return starts, bag, h, t, s, weight, z, sigmoid(z @ self.c + self.d)

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(x, counts)[-1]

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss, by the chain rule from the score back to the passages."""
        starts, bag, h, t, s, weight, z, p = self.forward(x, counts)
        g = (p - y) / len(y)
        gz = g[:, None] * self.c
        gh = weight[:, None] * gz[bag]
        gw = (h * gz[bag]).sum(axis=1)
        gl = weight * (gw - np.add.reduceat(weight * gw, starts)[bag])
        gts = gl[:, None] * self.a
        gt, gs = gts * s * (1 - t * t), gts * t * s * (1 - s)
        gh = gh + gt @ self.v.T + gs @ self.u.T
        gx = gh * (1 - h * h)
        return {"w1": x.T @ gx, "b1": gx.sum(axis=0), "v": h.T @ gt, "u": h.T @ gs, "a": (t * s).T @ gl, "c": z.T @ g, "d": g.sum()}


def learn(bags: list[np.ndarray], y: np.ndarray, seed: int = 7, epochs: int = EPOCHS, batch: int = 64) -> Model:
    """Adam over bags of passages."""
    rng = np.random.default_rng(seed)
    model = Model.fresh(rng, float(y.mean()) if len(y) else 0.5)
    if not len(y) or y.min() == y.max():
        model.c[:] = 0
        return model
    first = {f.name: np.zeros_like(getattr(model, f.name)) for f in fields(model)}
    second = {k: np.zeros_like(v) for k, v in first.items()}
    turn = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            x = np.concatenate([bags[i] for i in some]).astype(np.float32)
            grads = model.gradients(x, np.array([len(bags[i]) for i in some]), y[some].astype(np.float32))
            turn += 1
            for k, g in grads.items():
                g = g + DECAY * getattr(model, k)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                step = rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
                setattr(model, k, (getattr(model, k) - step).astype(np.float32))
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, label)``, one row per id, all of which may be learned from."""
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "label")
    total = labels.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = labels.filter(draw < most / max(most, total)).select("doc_id", "label")
    # Ids are drawn before texts are read; there are about ``most`` of them, so they may be broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            x, counts = encode(texts)
            bags = []
            for bag in np.split(x, np.cumsum(counts)[:-1]):
                some = np.unique(np.linspace(0, len(bag) - 1, min(len(bag), FIT_PASSAGES)).astype(int))
                bags.append(bag[some].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(bags, pa.binary())], ["doc_id", "label", "bag"])

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label {labels.schema['label'].dataType.simpleString()}, bag binary"
    # Sorted, so that the same rows give the same model however they were dealt.
    found = sorted(sample.mapInArrow(features, kind).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], bytes(r["bag"])))
    bags = [np.frombuffer(r["bag"], np.float16).reshape(-1, WIDTH) for r in found]
    return learn(bags, np.array([int(r["label"] == 1) for r in found]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            p = model.scores(*encode(texts)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every whole text of ``documents``, learned from labelled rows whose id's crc32 mod 3 isn't 1."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    labels = table(spark, sf_dir, "labels").filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label")).filter(~held_out)
    model = fit(docs, labels)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
