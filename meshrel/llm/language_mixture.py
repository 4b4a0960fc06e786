"""Language ID by multilingual mixture inference.

Each learned language is a distribution over hashed byte trigrams. A text is a
mixture of them: expectation-maximisation finds the proportions, and a
penalised likelihood (half the log of the gram count for each language) says
how many languages the text holds: sets grow by the language of next largest
proportion as long as it rises. The largest proportion is the prediction.

Defined cases: a text that is null or has no letter is ``und`` with score 0.
Null ``lang`` rows teach nothing. Without any training row all texts are
``und``. Ties in proportion go to the language first in the alphabet. Very long
texts are counted whole, block by block. Repeated rows are scored alike; further
columns are ignored; an empty table gives an empty result.
Broadcast: one table of languages x ``BUCKETS`` floats, 16 kB a language of the
``lang`` column; the driver and the tasks see no more of the training texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import crc_mod

BUCKETS = 4096
PER_LANGUAGE = 600
ROUNDS = 12
SET_ROUNDS = 4


@dataclass
class LanguageModel:
    names: list[str]
    p: np.ndarray  # languages x BUCKETS

    def proportions(self, counts: np.ndarray) -> np.ndarray:
        """Mixture proportions of each row of counts, over the language set that the penalised likelihood selects."""
        rows, k = len(counts), len(self.names)
        n = np.maximum(counts.sum(1, keepdims=True), 1)

        def em(theta: np.ndarray, rounds: int, at: np.ndarray) -> np.ndarray:
            own = counts[at]
            for _ in range(rounds):
                theta = theta * ((own / (theta @ self.p + 1e-12)) @ self.p.T) / n[at]
                theta /= np.maximum(theta.sum(1, keepdims=True), 1e-12)
            return theta

        def penalised(counts: np.ndarray, theta: np.ndarray, size: int) -> np.ndarray:
            return (counts * np.log(theta @ self.p + 1e-12)).sum(1) - 0.5 * size * np.log(n[at, 0] + 1)

        at = np.arange(rows)
        full = em(np.full((rows, k), 1 / k, np.float32), ROUNDS, at)
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
        best = (rank < 1).astype(np.float32)
        value = penalised(counts, best, 1)
        for size in range(2, k + 1):  # for the texts whose value still rises
            theta = np.where(rank[at] < size, full[at], 0)
            theta = em(theta / np.maximum(theta.sum(1, keepdims=True), 1e-12), SET_ROUNDS, at).astype(np.float32)
            now = penalised(counts[at], theta, size)
            up = now > value[at]
            best[at[up]], value[at[up]] = theta[up], now[up]
            at = at[up]
            if not len(at):
                break
        return best


def gram_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return K.ngram_counts(K.LOWER[data], offs, BUCKETS)


def _totals(texts: pa.Array, which: np.ndarray, kinds: int) -> np.ndarray:
    total = np.zeros((kinds, BUCKETS))
    raw, offs = K.utf8(texts)
    for part in K.row_groups(offs):
        np.add.at(total, which[part], gram_counts(raw[offs[part.start] : offs[part.stop]], offs[part.start : part.stop + 1] - offs[part.start]))
    return total


def _model(names: list[str], total: np.ndarray) -> LanguageModel:
    total = total + 0.2
    return LanguageModel(names, (total / total.sum(1, keepdims=True)).astype(np.float32))


def fit_rows(texts: pa.Array, names: list[str]) -> LanguageModel:
    """A model from texts and the language of each."""
    kinds = sorted(set(names))
    at = {x: i for i, x in enumerate(kinds)}
    return _model(kinds, _totals(texts, np.array([at[x] for x in names], np.int64), len(kinds)))


def fit(docs: DataFrame, modulus: int = 3, held: int = 1, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from about ``per_language`` texts of each language outside the held-out fold, drawn by a hash of the id.

    Grams are counted where the texts lie and summed by language in an exchange.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", modulus) != held)).select("doc_id", "text", "lang")
    # a row is drawn if its hash falls under its language's share
    share = known.groupBy("lang").agg(F.least(F.lit(1.0), per_language / F.count("*")).alias("share"))
    drawn = known.join(F.broadcast(share), "lang").where(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1)) < (F.col("share") * (1 << 30)).cast("long")).select("lang", "text")

    def count(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            kinds = sorted(set(names))
            at = {x: i for i, x in enumerate(kinds)}
            total = _totals(batch.column(1), np.array([at[x] for x in names], np.int64), len(kinds))
            row, cell = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()).take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(total[row, cell].astype(np.int64))], ["lang", "cell", "n"])

    cells = drawn.mapInArrow(count, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = cells.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))  # BUCKETS at most

    def pack(batches):
        for batch in batches:
            rows = []
            for x in batch.column(1):
                cell, n = (x.values.field(i).to_numpy() for i in (0, 1))
                total = np.zeros(BUCKETS)
                total[cell] = n
                rows.append(total.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["lang", "total"])

    got = sorted((r[0], bytes(r[1])) for r in found.mapInArrow(pack, "lang string, total binary").collect())
    return _model([x for x, _ in got], np.array([np.frombuffer(t) for _, t in got]).reshape(-1, BUCKETS))


def score_texts(model: LanguageModel, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
    names, scores = [], np.zeros(len(offs) - 1)
    letters = K.has_letter(data, offs)
    for part in K.row_groups(offs):
        own = offs[part.start : part.stop + 1]
        if not model.names:
            names += ["und"] * (part.stop - part.start)
            continue
        theta = model.proportions(gram_counts(data[own[0] : own[-1]], own - own[0]))
        best = theta.argmax(1)
        names += [model.names[b] if ok else "und" for b, ok in zip(best, letters[part], strict=True)]
        scores[part] = np.where(letters[part], theta.max(1), 0)
    return names, np.clip(scores, 0, 1)


def identify(docs: DataFrame, model: LanguageModel, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every text."""

    def run(batches):
        for batch in batches:
            for rows, data, offs in K.chunks(batch, "text"):
                names, scores = score_texts(model, data, offs)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    picked = docs.select("doc_id", F.coalesce(crc_mod("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "text")
    return picked.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
