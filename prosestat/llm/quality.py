"""Quality by nearest-neighbour voting over latent-semantic vectors.

A bounded sample of labelled texts (``PER_CLASS`` of each class, by hash order) is turned into
weighted term vectors; a truncated SVD gives the latent space. The sample's vectors and labels
are broadcast: their size is fixed by the parameters, whatever the corpus. Every document is
then projected and compared with all of them by exact blocked cosine products, and its nearest
neighbours vote with their similarity as weight.

Terms are hashed byte trigrams, in which capitals and digits are folded into classes, and a few
terms for the text's shape: how often words and lines repeat, shares of capitals, symbols and
digits, and length. Labels, lang, source and doc_id are never inputs of a score.

Defined cases: a null text counts as empty; a text without any term, or a corpus without
labels, gets the prior; labels that are null or not 0 or 1 are ignored, several for one
document are averaged; a null doc_id is never used for fitting; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, text_bytes, tune

PER_CLASS = 1000  # the bound of the fitted sample, for each label
TERMS = 4096
SHAPES = 7
LEVELS = 12
WIDTH = TERMS + SHAPES * LEVELS
RANK = 64
NEIGHBOURS = 25
ACCEPT = 0.7
SHAPE_WEIGHT = 6.0
#: Votes weigh similarity to this power, so near neighbours outvote merely similar ones.
SHARPNESS = 8
#: Rows of one product, always: with another height a library may add up in another order.
HEIGHT = 256


def _classes() -> np.ndarray:
    c = np.arange(256)
    c[ord("A") : ord("Z") + 1] = ord("A")
    c[ord("0") : ord("9") + 1] = ord("0")
    c[[9, 11, 12, 13]] = 32
    return c.astype(np.uint32)


_CLASS = _classes()


def _level(x: float) -> int:
    return min(LEVELS - 1, max(0, int(x * (LEVELS - 1) + 0.5)))


def features(text: bytes) -> np.ndarray:
    """Raw term weights of one text, WIDTH float32."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    raw = np.frombuffer(text, np.uint8)
    c = _CLASS[raw]
    if len(c) >= 3:
        h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[:TERMS] = np.log1p(np.bincount(h >> np.uint32(20), minlength=TERMS))
    words = text.split()
    if not words:
        return out
    n, counts = len(words), Counter(words)
    lines = text.split(b"\n")
    held = np.bincount(raw, minlength=256)
    letters = int(held[65:91].sum() + held[97:123].sum() + held[128:].sum())
    repeats = sum(map(bytes.__eq__, words, words[1:])) / n
    shape = (
        repeats,
        counts.most_common(1)[0][1] / n if n > 3 else 0.0,
        1 - len(set(lines)) / len(lines),
        held[65:91].sum() / max(1, letters),
        min(1.0, 2 * (len(raw) - letters - held[32] - held[10]) / len(raw)),
        held[48:58].sum() / len(raw),
        np.log2(1 + n) / 16,
    )
    for k, x in enumerate(shape):
        out[TERMS + k * LEVELS + _level(float(x))] = SHAPE_WEIGHT
    return out


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if texts else np.zeros((0, WIDTH), np.float32)


def _unit(m: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return np.divide(m, n, out=np.zeros_like(m) if out is None else out, where=n > 0)


class Model:
    """idf weights, latent basis, the labelled vectors and the prior."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = RANK, prior: float = 0.5) -> None:
        """counts (texts x WIDTH float32) is used up: weights are put in its place."""
        self.prior, self.labels = prior, labels.astype(np.float64)
        n = len(counts)
        self.idf = (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
        x = counts
        x *= self.idf
        _unit(x, out=x)
        rng = np.random.default_rng(17)
        k = min(rank, n, WIDTH)
        y = x @ rng.standard_normal((WIDTH, min(k + 12, WIDTH))).astype(np.float32)
        for _ in range(4):
            y, _r = np.linalg.qr(x @ (x.T @ y))
        _u, _s, v = np.linalg.svd(y.T @ x, full_matrices=False)
        self.basis = np.ascontiguousarray(v[:k].T)
        self.vectors = _unit(x @ self.basis).astype(np.float64)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Votes for each row of counts, HEIGHT rows at a time. Cosines are taken in
        double precision and rounded to six places, and ties go to the earlier labelled text, so
        a text's score is the same in any batch."""
        out = np.empty(len(counts))
        k = min(NEIGHBOURS, len(self.vectors))
        first = len(self.vectors) - 1 - np.arange(len(self.vectors))
        for i in range(0, len(counts), HEIGHT):
            part = np.zeros((HEIGHT, WIDTH))
            rows = len(counts[i : i + HEIGHT])
            part[:rows] = counts[i : i + HEIGHT]
            part *= self.idf
            z = _unit(_unit(part, out=part) @ self.basis)
            near = np.rint((z @ self.vectors.T)[:rows] * 1e6).astype(np.int64)
            order = near * len(self.vectors) + first
            top = np.argpartition(-order, k - 1, axis=1)[:, :k] if k < len(first) else np.tile(np.arange(k), (rows, 1))
            top.sort(axis=1)
            w = np.clip(np.take_along_axis(near, top, axis=1) / 1e6, 0, 1) ** SHARPNESS
            total = w.sum(axis=1)
            vote = (w * self.labels[top]).sum(axis=1)
            out[i : i + rows] = np.round(np.divide(vote, total, out=np.full(rows, self.prior), where=total > 1e-12), 9)
        return out


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Fit on at most 2 * per_class labelled documents that aren't held out."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")).where(~held_out())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("y = 1").orderBy(*order).limit(per_class).union(known.where("y = 0").orderBy(*order).limit(per_class))
    texts = docs.select("doc_id", text_bytes().alias("text"))

    def pack(batches):
        for b in batches:
            rows = [features(t.as_py()).astype(np.float16) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "y", "f"])

    # The sample is at most 2 * per_class texts' vectors, each of WIDTH half-precision weights.
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y").mapInArrow(pack, "doc_id long, y int, f binary").collect()
    # Where rows repeat a doc_id, one of them stands for it.
    rows = sorted({r["doc_id"]: r for r in sorted(rows, key=lambda r: (r["doc_id"], bytes(r["f"])), reverse=True)}.values(), key=lambda r: r["doc_id"])
    if not rows:
        return None
    x = np.empty((len(rows), WIDTH), np.float32)
    for k, r in enumerate(rows):
        x[k] = np.frombuffer(r["f"], np.float16)
    y = np.array([r["y"] for r in rows])
    return Model(x, y, prior=float(y.mean()))


def votes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of each row."""
    tune(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    schema = "doc_id long, score double"

    def vote(batches):
        m = model.value
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for i in range(0, b.num_rows, 256):
                part = [t.as_py() for t in texts[i : i + 256]]
                s = m.scores(matrix(part)) if m else np.full(len(part), 0.5)
                yield pa.RecordBatch.from_arrays([ids[i : i + 256], pa.array(s, pa.float64())], schema=fields(schema))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(vote, schema)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    return votes(docs, labels).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs (columns of documents) that score at least ``ACCEPT``, as they are."""
    tune(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    place = docs.columns.index("text")

    def choose(batches):
        m = model.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [(t.as_py() or "").encode() for t in part.column(place)]
                ok = m.scores(matrix(texts)) >= ACCEPT if m else np.ones(len(texts), bool)
                yield part.filter(pa.array(ok))

    return docs.mapInArrow(choose, docs.schema)
