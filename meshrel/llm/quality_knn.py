"""Quality by nearest-neighbour voting in a latent semantic space.

Texts become tf-idf vectors of hashed byte trigrams (case and symbols kept),
projected by a truncated SVD of the labelled sample. Every text is compared with
every labelled vector (exact cosines, a block of texts at a time) and its
``NEIGHBOURS`` nearest vote with their similarity to a power as weight.

Defined cases: null and empty texts have no neighbour and get the base rate; so
does everything when no training row exists (0.5). Very long texts are counted
whole, block by block. Ties in similarity (to 12 digits) go to the sample's
order, that of the ids' hashes. Repeated rows are scored alike; further columns
are ignored; an empty table gives an empty result.
Broadcast: ``SAMPLE`` x ``DIMS`` and ``BUCKETS`` x ``DIMS`` numbers (under 3 MB).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import crc_mod, fit_in_task, labelled_sample

BUCKETS = 4096
DIMS = 48
SAMPLE = 3000
NEIGHBOURS = 15
POWER = 8


@dataclass
class QualityModel:
    idf: np.ndarray
    axes: np.ndarray  # BUCKETS x DIMS
    vectors: np.ndarray  # sample x DIMS, unit length
    y: np.ndarray
    base: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        v = (np.log1p(counts.astype(np.float64)) * self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.y):
            return np.full(len(counts), self.base)
        cosines = np.round(self.embed(counts) @ self.vectors.T, 12)  # sums differ in their last bits with a block's size
        k = min(NEIGHBOURS, len(self.y))
        least = np.partition(cosines, len(self.y) - k, axis=1)[:, -k, None]
        above, level = cosines > least, cosines == least
        near = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True)))
        weight = np.where(near, np.maximum(cosines, 0), 0) ** POWER
        total = weight.sum(1)
        return np.where(total > 1e-9, weight @ self.y / np.maximum(total, 1e-9), self.base)


def fit_rows(texts: pa.Array, y: np.ndarray, dims: int = DIMS) -> QualityModel:
    if not len(y):
        return QualityModel(np.ones(BUCKETS, np.float32), np.zeros((BUCKETS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    raw, offs = K.utf8(texts)
    counts = np.concatenate([K.ngram_counts(raw[offs[p.start] : offs[p.stop]], offs[p.start : p.stop + 1] - offs[p.start], BUCKETS) for p in K.row_groups(offs)])
    idf = np.log((len(y) + 1) / ((counts > 0).sum(0) + 1)).astype(np.float32) + np.float32(0.1)
    x = np.log1p(counts) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(7)
    q = x.T @ rng.standard_normal((len(x), min(dims + 16, len(x)))).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(q)
        q = x.T @ (x @ q)
    q, _ = np.linalg.qr(q)
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    axes = (q @ vt.T[:, :dims]).astype(np.float32)
    model = QualityModel(idf, axes, np.zeros((0, 1), np.float32), y.astype(np.float64), float(y.mean()))
    model.vectors = np.concatenate([model.embed(counts[a : a + 256]) for a in range(0, len(counts), 256)])
    return model


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, sample: int = SAMPLE) -> QualityModel:
    drawn = labelled_sample(docs, labels, "quality", modulus, held, sample).select("doc_id", "text", "y")
    return fit_in_task(drawn, lambda t: fit_rows(t["text"], t["y"].to_numpy().astype(np.float64)))


def classify(docs: DataFrame, model: QualityModel, modulus: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every text."""

    def run(batches):
        for batch in batches:
            for rows, data, offs in K.chunks(batch, "text"):
                score = np.concatenate([model.vote(K.ngram_counts(data[offs[p.start] : offs[p.stop]], offs[p.start : p.stop + 1] - offs[p.start], BUCKETS)) for p in K.row_groups(offs)])
                score = np.clip(score, 0, 1)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    picked = docs.select("doc_id", F.coalesce(crc_mod("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "text")
    return picked.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
