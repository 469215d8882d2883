"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage becomes a vector of shares of byte and word classes; a
small network encodes it, a gated attention (tanh times sigmoid) learned from the document labels alone weighs the
passages, and the weighted sum is scored. Labels, language, source and id are never inputs.

The network is fitted on the driver from all passages of at most ``sample`` labelled documents, those with the lowest hash
of their id; a passage is 92 bytes there, about a quarter of its text. Of rows that share an id one is learned from, that
with the lowest hash of its text. Rows whose crc32(doc_id) mod 4 is 2 are held out. Scoring is one pass over the texts, in
blocks of ``BLOCK_BYTES`` and one text at least.

Defined cases: null and empty texts have one passage of zeros and get its score; rows are scored one by one, repeated ones
alike; a very long text is a block of its own, all its passages are read; duplicate labels of an id count once by their mean,
and null labels not at all; without labels of both kinds every score is 0.5; columns of other names are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import word_arrays as W
from .quality_rules import STOP_WORDS

PASSAGE = 64
#: Bytes of text handled at once.
BLOCK_BYTES = 2_000_000
HIDDEN = 16
#: Byte classes: other, symbols, exclamation and question marks, capitals, digits, small letters, sentence marks, line feeds, beyond ASCII.
CLASSES = 9
CLASS = np.zeros(256, np.uint8)
CLASS[list(b"#*$%&|<>")] = 1
CLASS[list(b"!?")] = 2
CLASS[0x41:0x5B] = 3
CLASS[0x30:0x3A] = 4
CLASS[0x61:0x7B] = 5
CLASS[list(b".,;:")] = 6
CLASS[0x0A] = 7
CLASS[0x80:] = 8
FEATURES = 2 * CLASSES + 5


def hash_list(words: list[str]) -> np.ndarray:
    data, offsets = W.raw(pa.array(words))
    return np.sort(W.hashes(data, offsets[:-1], offsets[1:]))


STOP_HASHES = hash_list(sorted(set(STOP_WORDS)))


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the first passage of each text (and the end)."""
    data, offsets = W.raw(texts)
    begin, end, upto = W.words(data, offsets)
    counts = np.diff(upto)
    bags = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate([[0], np.cumsum(bags)])
    n = int(first[-1])
    out = np.zeros((n, FEATURES), np.float32)
    if len(begin):
        doc = np.repeat(np.arange(len(counts)), counts)
        of = first[doc] + (np.arange(len(begin)) - upto[doc]) // PASSAGE  # each word's passage
        words = np.bincount(of, minlength=n).astype(np.float64)
        per = np.maximum(words, 1)
        # bytes between words belong to the word before
        reach = np.append(begin[1:], len(data)) - begin
        reach[np.append(doc[1:] != doc[:-1], True)] = (offsets[1:][doc] - begin)[np.append(doc[1:] != doc[:-1], True)]
        inside = np.repeat(of, reach)
        at = np.repeat(begin - (np.cumsum(reach) - reach), reach) + np.arange(len(inside))
        kinds = np.bincount(inside * CLASSES + CLASS[data[at]], minlength=n * CLASSES).reshape(n, CLASSES)
        chars = np.maximum(kinds.sum(1, keepdims=True), 1)
        out[:, :CLASSES] = kinds / chars
        out[:, CLASSES : 2 * CLASSES] = np.log1p(kinds / per[:, None])
        size = end - begin
        h = W.hashes(data, begin, end)
        near = np.minimum(np.searchsorted(STOP_HASHES, h), len(STOP_HASHES) - 1)
        order = np.argsort(h, kind="stable")
        order = order[np.argsort(of[order], kind="stable")]
        again = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])])
        k = 2 * CLASSES
        out[:, k] = np.log1p(np.bincount(of, size, n) / per)
        out[:, k + 1] = np.bincount(of, size == 1, n) / per
        out[:, k + 2] = np.bincount(of, STOP_HASHES[near] == h, n) / per
        out[:, k + 3] = np.bincount(of[order], again, n) / per
        out[:, k + 4] = words / PASSAGE
    return out, first


def sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first[:-1], axis=0)


class Network:
    """Encoder, gated attention and score; ``values`` is the list of its arrays."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.values = [
            draw(FEATURES, HIDDEN),
            np.zeros(HIDDEN),
            draw(HIDDEN, HIDDEN),
            draw(HIDDEN, HIDDEN),
            draw(HIDDEN, 1)[:, 0],
            draw(HIDDEN, 1)[:, 0],
            np.zeros(1),
        ]

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        enc, bias, tan, sig, att, top, shift = self.values
        e = np.tanh(((x - self.mean) / self.scale) @ enc + bias)
        t, g = np.tanh(e @ tan), 1 / (1 + np.exp(-(e @ sig)))
        raw = (t * g) @ att
        sizes = np.diff(first)
        weight = np.exp(raw - np.repeat(np.maximum.reduceat(raw, first[:-1]), sizes))
        weight /= np.repeat(sums(weight, first), sizes)
        z = sums(weight[:, None] * e, first)
        return e, t, g, weight, z, z @ top + shift[0]

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.forward(x, first)[-1])) if len(first) > 1 else np.zeros(0)

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        enc, bias, tan, sig, att, top, shift = self.values
        e, t, g, weight, z, logit = self.forward(x, first)
        sizes = np.diff(first)
        d = (1 / (1 + np.exp(-logit)) - y) / len(y)
        dz = np.repeat(d, sizes)[:, None] * top
        along = (dz * e).sum(1)
        draw = weight * (along - np.repeat(sums(weight * along, first), sizes))
        dt, dg = draw[:, None] * att * g * (1 - t * t), draw[:, None] * att * t * g * (1 - g)
        de = (weight[:, None] * dz + dt @ tan.T + dg @ sig.T) * (1 - e * e)
        return [((x - self.mean) / self.scale).T @ de, de.sum(0), e.T @ dt, e.T @ dg, (t * g).T @ draw, z.T @ d, np.array([d.sum()])]


def fit(
    x: np.ndarray,
    first: np.ndarray,
    y: np.ndarray,
    epochs: int = 40,
    batch: int = 256,
    rate: float = 0.01,
    decay: float = 1e-4,
    seed: int = 7,
) -> Network:
    """Adam on the cross entropy of document labels."""
    net = Network(seed)
    net.mean, net.scale = x.mean(0), x.std(0) + 1e-3
    r = np.random.default_rng(seed)
    m, v, step = [np.zeros_like(a) for a in net.values], [np.zeros_like(a) for a in net.values], 0
    for epoch in range(epochs):
        order = r.permutation(len(y))
        for a in range(0, len(y), batch):
            pick = order[a : a + batch]
            sizes = first[pick + 1] - first[pick]
            begin = np.concatenate([[0], np.cumsum(sizes)])
            rows = np.repeat(first[pick] - begin[:-1], sizes) + np.arange(begin[-1])
            step += 1
            for k, grad in enumerate(net.gradients(x[rows], begin, y[pick])):
                grad = grad + decay * net.values[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                now = rate * (1 - epoch / epochs)
                net.values[k] = net.values[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 6000,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> Network | None:
    """The network fitted on the sample; none if it lacks one of the two labels."""
    known = labels.select(
        F.col(f"`{doc_id}`").cast("long").alias("i"),
        F.col(f"`{label}`").cast("double").alias("y"),
    ).where("i IS NOT NULL AND y IS NOT NULL")
    known = known.where(~held_out(F.col("i"))).groupBy("i").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(sample)
    bags = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("i"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"),
    ).join(F.broadcast(known), "i")
    bags = bags.groupBy("i").agg(F.min("y").alias("y"), F.min(F.struct(F.xxhash64("t"), "t")).alias("t")).select("i", "y", "t.t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.blocks(batch.column(2), BLOCK_BYTES):
                part = batch.slice(a, b - a)
                x, first = passages(part.column(part.schema.get_field_index("t")))
                blobs = [x[p:q].tobytes() for p, q in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("i")),
                        part.column(part.schema.get_field_index("y")),
                        pa.array(blobs, pa.binary()),
                    ],
                    ["i", "y", "x"],
                )

    found = bags.mapInArrow(run, "i long, y double, x binary").toPandas().sort_values(["i", "x"], kind="stable")
    if not len(found) or not (found.y > 0.5).any() or not (found.y <= 0.5).any():
        return None
    parts = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in found.x]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return fit(np.concatenate(parts).astype(np.float64), first, found.y.to_numpy())


def score(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """docs without the text, with ``score``."""
    rest = [c for c in docs.columns if c not in (text, "score")]
    df = docs.select(*[f"`{c}`" for c in rest], F.col(f"`{text}`").alias("__qc_t"))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.blocks(batch.column(len(rest)), BLOCK_BYTES):
                part = batch.slice(a, b - a)
                x, first = passages(part.column(len(rest)))
                s = net.score(x, first) if net else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s)], schema.names)

    return df.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    df = score(docs.select(f"`{doc_id}`", f"`{text}`"), train(docs, labels, doc_id=doc_id, text=text, **how), text)
    return df.select(
        doc_id,
        held_out(F.col(f"`{doc_id}`")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
