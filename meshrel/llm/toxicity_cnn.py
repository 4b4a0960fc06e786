"""Toxicity by a convolutional text classifier.

Lower-cased letter runs are hashed into an embedding table; filters of widths
1, 2 and 3 slide over the whole text, their maxima feed a logistic unit. The
network is trained in numpy on a bounded labelled sample. The cut is calibrated
for each language that the text itself shows (by trigram likelihoods, never by
the ``lang`` column) and moved to a score of ``CUT``.

Defined cases: null and empty texts have zero features and score by the bias
(below the cut when trained); without training rows all score 0. Repeated rows
are scored alike; further columns are ignored.
Broadcast: 2^``BITS`` x ``DIM`` floats (8 MB) and the language tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import language_mixture as L
from .tables import crc_mod, fit_in_task, labelled_sample

BITS = 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
SAMPLE = 8000
EPOCHS = 6
CUT = 0.7

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed ids of the letter runs, and each text's border in them."""
    starts, ends = K._spans(_TOKEN[data], offs)
    return (K.span_hash(K.LOWER[data], starts, ends) >> np.uint64(64 - BITS)).astype(np.int32), np.searchsorted(starts, offs)


@dataclass
class ToxicityModel:
    table: np.ndarray
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    weights: np.ndarray
    bias: float
    languages: L.LanguageModel
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def pooled(self, ids: np.ndarray, borders: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maximum of each filter over each text (0 at least) and, if asked, where it stands."""
        rows = len(borders) - 1
        out = np.zeros((rows, len(WIDTHS) * FILTERS), np.float32)
        at = np.full(out.shape, -1, np.int64) if where else None
        if not len(ids):
            return out, at
        e = self.table[ids]
        text_end = np.repeat(borders[1:], np.diff(borders))
        for j, (width, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            n = len(ids) - width + 1
            if n <= 0:
                continue
            v = e[:n] @ f[0]
            for k in range(1, width):
                v += e[k : n + k] @ f[k]
            v[np.arange(n) + width > text_end[:n]] = -1
            for r0 in range(0, rows, 4096):
                lo = np.minimum(borders[r0 : r0 + 4097], n)
                full = np.flatnonzero(np.diff(lo) > 0)
                if not len(full):
                    continue
                block = v[lo[0] : lo[-1]]
                top = np.maximum.reduceat(block, lo[full] - lo[0], axis=0)
                own = slice(j * FILTERS, (j + 1) * FILTERS)
                out[r0 + full, own] = np.maximum(top, 0)
                if where:
                    for r, t in zip(full, top, strict=True):
                        place = v[lo[r] : lo[r + 1]].argmax(0) + lo[r]
                        at[r0 + r, own] = np.where(t > 0, place, -1)
        return out, at

    def logits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return self.pooled(*tokens(data, offs))[0] @ self.weights + self.bias

    def language(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Likeliest language of each text, len(names) where none is known."""
        k = len(self.languages.names)
        out = np.full(len(offs) - 1, k)
        if k:
            logp = np.log(self.languages.p.T)
            for p in K.row_groups(offs):
                counts = L.gram_counts(data[offs[p.start] : offs[p.stop]], offs[p.start : p.stop + 1] - offs[p.start])
                out[p] = np.where(counts.any(1), (counts @ logp).argmax(1), k)
        return out

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = self.logits(data, offs) - self.cuts[self.language(data, offs)] + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap at which F1 is largest."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    i = int(f1.argmax())
    below = z[order[i + 1]] if i + 1 < len(z) else z[order[i]] - 1
    return float((z[order[i]] + below) / 2)


def fit_rows(texts: pa.Array, y: np.ndarray, languages: L.LanguageModel, epochs: int = EPOCHS) -> ToxicityModel:
    rng = np.random.default_rng(11)
    table = (rng.standard_normal((1 << BITS, DIM)) * 0.05).astype(np.float32)
    filters = [(rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
    model = ToxicityModel(table, filters, np.zeros(len(WIDTHS) * FILTERS, np.float32), -30.0, languages, np.zeros(len(languages.names) + 1))
    if not len(y) or y.min() == y.max():
        return model
    raw, offs = K.utf8(texts)
    # a few texts at a time: hashing needs several words of memory for each byte
    parts = [tokens(raw[offs[p.start] : offs[p.stop]], offs[p.start : p.stop + 1] - offs[p.start]) for p in K.row_groups(offs)]
    ids = np.concatenate([i for i, _ in parts])
    borders = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))])
    del parts
    rows = len(y)
    held = np.arange(rows) % 4 == 3 if rows >= 40 else np.zeros(rows, bool)
    # first embedding coordinate: shrunk log-odds of a word's presence in toxic texts
    pair = np.unique(np.repeat(np.arange(rows, dtype=np.int64), np.diff(borders)) << BITS | ids)
    which, word = pair >> BITS, pair & ((1 << BITS) - 1)
    use = ~held[which]
    c1 = np.bincount(word[use & (y[which] == 1)], minlength=1 << BITS)
    c0 = np.bincount(word[use & (y[which] == 0)], minlength=1 << BITS)
    odds = np.log((c1 + 1) / (y[~held].sum() + 2)) - np.log((c0 + 1) / ((1 - y[~held]).sum() + 2))
    table[:, 0] = np.clip(odds * (c1 + c0) / (c1 + c0 + 10), -2, 6) / 2
    filters[0][:, 0, : FILTERS // 2] = 1
    model.weights[:] = 0.5
    model.bias = -2.0
    rate, squares = 0.05, [1e-8, *(np.full_like(f, 1e-8) for f in filters), np.full_like(model.weights, 1e-8)]
    seen = np.full(table.shape, 1e-8, np.float32)
    train = np.flatnonzero(~held)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            own = np.concatenate([ids[borders[r] : borders[r + 1]] for r in batch])
            edge = np.concatenate([[0], np.cumsum(borders[batch + 1] - borders[batch])])
            x, at = model.pooled(own, edge, where=True)
            z = np.clip(x @ model.weights + model.bias, -30, 30)
            g = ((1 / (1 + np.exp(-z)) - y[batch]) * weight[batch] / len(batch)).astype(np.float32)
            dx = g[:, None] * model.weights
            dw, db = x.T @ g + 1e-4 * model.weights, float(g.sum())
            for j, (width, f) in enumerate(zip(WIDTHS, filters, strict=True)):
                r, c = np.nonzero(at[:, j * FILTERS : (j + 1) * FILTERS] >= 0)
                place, d = at[r, j * FILTERS + c], dx[r, j * FILTERS + c]
                df = np.zeros_like(f)
                for k in range(width):
                    word_at = own[place + k]
                    np.add.at(df[k].T, c, d[:, None] * table[word_at])
                    de = d[:, None] * f[k][:, c].T
                    np.add.at(seen, word_at, de * de)
                    np.add.at(table, word_at, -0.5 * rate * de / np.sqrt(seen[word_at]))
                squares[1 + j] += df * df
                f -= rate * df / np.sqrt(squares[1 + j])
            squares[-1] += dw * dw
            model.weights -= rate * dw / np.sqrt(squares[-1])
            squares[0] += db * db
            model.bias -= rate * db / squares[0] ** 0.5
    z = np.concatenate([model.pooled(ids[borders[a] : borders[min(a + 256, rows)]], borders[a : min(a + 256, rows) + 1] - borders[a])[0] for a in range(0, rows, 256)]) @ model.weights + model.bias
    test = held if held.any() and 0 < y[held].sum() < held.sum() else np.ones(rows, bool)
    common = _best_cut(z[test], y[test])
    kind = model.language(raw, offs)
    for k in range(len(model.cuts)):
        own = test & (kind == k)
        enough = y[own].sum() >= 20 and (1 - y[own]).sum() >= 20
        model.cuts[k] = _best_cut(z[own], y[own]) if enough else common
    return model


def train(drawn: pa.Table) -> ToxicityModel:
    """The model of a sample (text, lang, y)."""
    named = drawn.filter(drawn["lang"].is_valid())
    languages = L.fit_rows(named["text"], named["lang"].to_pylist()) if named.num_rows else L.LanguageModel([], np.zeros((0, L.BUCKETS), np.float32))
    return fit_rows(drawn["text"], drawn["y"].to_numpy().astype(np.float64), languages)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, sample: int = SAMPLE) -> ToxicityModel:
    return fit_in_task(labelled_sample(docs, labels, "toxic", modulus, held, sample), train)


def classify(docs: DataFrame, model: ToxicityModel, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every text."""

    def run(batches):
        for batch in batches:
            for rows, data, offs in K.chunks(batch, "text", 2 << 20):
                score = model.scores(data, offs)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    picked = docs.select("doc_id", F.coalesce(crc_mod("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "text")
    return picked.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs, all columns kept, whose text scores below the cut."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for rows, data, offs in K.chunks(batch, names[at], 2 << 20):
                yield rows.filter(pa.array(model.scores(data, offs) < CUT))

    return docs.mapInArrow(run, docs.schema)
