"""Quality rules: counted rules, then line labelling by a linear-chain conditional random field.

Every \\n-split line is content or boilerplate; Viterbi decoding finds the best
labelling of a text's lines together, and a text is retained if lines marked
content hold at least ``SHARE`` of its word characters. The field maximises the
penalised log-likelihood of the weakly labelled lines of all texts: a line is
boilerplate if symbols, capitals, pipes or digits crowd it, or if it is short and
recurs: ``TIMES`` times in all texts at least, and once for ``PER`` texts. Tasks
sum the likelihood and its gradient over every line; the driver gets the sums and
takes quasi-Newton steps until the gradient is gone (``STEPS`` at most). The
likelihood is concave, so the weights depend on the texts alone, in any order;
they are rounded to six decimals.

Defined cases: null and empty texts count zero words, fail the base rules and
are not kept. Repeated rows are judged alike, and each is trained on; further
columns are ignored. Texts without a word character: every line is content.
Broadcast: a few dozen weights, and hashes of the short lines that recur, no more
than ``PER`` times the short lines of a mean text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import discard, save

PIECE = 200
SHARE = 0.5
STEPS = 60
SHORT = 60  # bytes
TIMES, PER = 5, 400
PENALTY = 1e-4
CHUNK = 2 << 20
AT_ONCE = 1 << 17  # lines that a task sums over together

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LOWER[128:] = True
_LOUD = np.zeros(256, bool)
_LOUD[[ord(c) for c in "!?~^_=+\\/@"]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:;\"')"]] = True
FEATURES = 9


@dataclass
class LineField:
    emit: np.ndarray  # FEATURES: score of content over boilerplate
    step: np.ndarray  # 2 x 2: from, to

    def decode(self, x: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Viterbi for all texts at once: 1 where a line is content."""
        rows, longest = len(borders) - 1, int(np.diff(borders).max(initial=0))
        n = len(x)
        score = np.stack([np.zeros(n), x @ self.emit], 1)
        back = np.zeros((n, 2), np.int8)
        order = np.argsort(-np.diff(borders), kind="stable")  # texts with more lines first: a prefix is live at each step
        heads, lens = borders[:-1][order], np.diff(borders)[order]
        live = rows
        best = score[heads[:live]].copy() if rows else score[:0]
        ends = np.zeros(rows, np.int8)
        for t in range(1, longest + 1):
            still = int(np.searchsorted(-lens, -t, "left")) if t <= longest else 0  # texts with more than t lines
            ends[still:live] = best[still:live].argmax(1)
            live = still
            if not live:
                break
            way = best[:live, :, None] + self.step[None]
            at = heads[:live] + t
            back[at] = way.argmax(1)
            best = way.max(1) + score[at]
        label = np.zeros(n, np.int8)
        current = ends.copy()
        for t in range(longest - 1, -1, -1):
            live = int(np.searchsorted(-lens, -t, "left"))
            at = heads[:live] + t
            label[at] = current[:live]
            current[:live] = back[at, current[:live]]
        return label


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Features, borders of texts in lines, word characters of each line, line spans."""
    starts, ends, borders = K.lines(data, offs)
    size = np.maximum(K.per_span(~K.SPACE[data], starts, ends), 1)
    share = lambda mask: K.per_span(mask[data], starts, ends) / size
    first = np.zeros(len(data), bool)
    w = K.words(data, offs, hashed=False)
    first[w.starts] = True
    count = K.per_span(first, starts, ends)
    closed = np.zeros(len(starts))
    full = ends > starts
    closed[full] = _END[data[ends[full] - 1]]
    x = np.stack(
        [np.ones(len(starts)), np.minimum(10 * share(_SYMBOL), 3), np.minimum(5 * share(_LOUD), 3), 3 * share(_DIGIT), 3 * share(_UPPER), share(_LOWER), np.log1p(count) / 3, closed, (count == 0).astype(float)],
        1,
    )
    chars = K.per_span(~K.SPACE[data] & ((data & 0xC0) != 0x80), starts, ends)
    return x, borders, chars, (starts, ends)


def short_lines(raw: np.ndarray, spans: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where the short lines are that aren't empty, and their hashes."""
    lens = spans[1] - spans[0]
    at = np.flatnonzero((lens > 0) & (lens < SHORT))
    return at, K.span_hash(raw, spans[0][at], spans[1][at])


def recurring(hashes: np.ndarray, times: np.ndarray, texts: int) -> np.ndarray:
    """Of hashes with their numbers of places in so many texts, those that recur, ascending."""
    return np.sort(hashes[(times >= TIMES) & (PER * times >= texts)])


def weak_labels(raw: np.ndarray, offs: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Features, labels (1: content), borders of texts in lines, and whether there is a word character."""
    x, borders, chars, spans = line_features(raw, offs)
    boilerplate = (x[:, 1] > 0.5) | (x[:, 2] > 0.5) | (x[:, 3] > 0.9) | (x[:, 4] > 1.5) | (chars == 0)
    at, h = short_lines(raw, spans)
    boilerplate[at[np.isin(h, often)]] = True
    return x, (~boilerplate).astype(np.int64), borders, bool(chars.any())


def line_sums(x: np.ndarray, y: np.ndarray, borders: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Lines, the negative log-likelihood and its gradient, then the features' products, summed over whole texts."""
    n, emit, step = len(x), weights[:FEATURES], weights[FEATURES:].reshape(2, 2)
    pos = np.arange(n) - np.repeat(borders[:-1], np.diff(borders))
    heads = np.flatnonzero(pos % PIECE == 0)  # longer texts are trained on in pieces that cover them whole
    lens = np.diff(np.append(heads, n))
    piece = np.repeat(np.arange(len(heads)), lens)
    ends = heads + lens - 1
    order = np.argsort(-lens, kind="stable")  # longer pieces first: a prefix is live at each step
    firsts, longest = heads[order], int(lens.max(initial=0))
    live = np.searchsorted(-lens[order], -np.arange(longest + 1), "left")  # pieces of more than t lines
    s = x @ emit
    a, b = np.stack([np.zeros(n), s]), np.zeros((2, n))
    for t in range(1, longest):
        at = firsts[: live[t]] + t
        p, q = a[:, at - 1]
        a[0, at] += np.logaddexp(p + step[0, 0], q + step[1, 0])
        a[1, at] += np.logaddexp(p + step[0, 1], q + step[1, 1])
    for t in range(longest - 2, -1, -1):
        at = firsts[: live[t + 1]] + t
        p, q = b[0, at + 1], s[at + 1] + b[1, at + 1]
        b[0, at] = np.logaddexp(step[0, 0] + p, step[0, 1] + q)
        b[1, at] = np.logaddexp(step[1, 0] + p, step[1, 1] + q)
    z = np.logaddexp(a[0, ends], a[1, ends])
    each = z[piece]
    p1 = np.exp(np.minimum(a[1] + b[1] - each, 0))
    i = np.flatnonzero(piece[1:] == piece[:-1])  # followed by a line of the same piece
    ahead = np.stack([b[0, i + 1], s[i + 1] + b[1, i + 1]])
    want = np.array([np.exp(np.minimum(a[u, i] + step[u, v] + ahead[v] - each[i], 0)).sum() for u in (0, 1) for v in (0, 1)])
    seen = np.bincount(2 * y[i] + y[i + 1], minlength=4)
    value = z.sum() - (y * s).sum() - (seen * step.ravel()).sum()
    return np.concatenate([[n, value], x.T @ (p1 - y), want - seen, (x.T @ x).ravel()])


def train(sums: Callable[[np.ndarray], np.ndarray], steps: int = STEPS) -> LineField:
    """The field at the likelihood's maximum, by quasi-Newton steps; sums gives line_sums over all texts."""
    size = FEATURES + 4

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        found = sums(w)
        n = found[0]
        return found[1] / n + PENALTY / 2 * (w @ w), found[2 : 2 + size] / n + PENALTY * w, found[2 + size :] / n

    w = np.zeros(size)
    value, slope, products = at(w)
    curve = np.eye(size) / 4
    curve[:FEATURES, :FEATURES] = products.reshape(FEATURES, FEATURES) / 4
    guess = np.linalg.inv(curve + PENALTY * np.eye(size))
    for _ in range(steps):
        if np.abs(slope).max() < 1e-6:
            break
        way, length = -guess @ slope, 1.0
        while True:
            new, new_slope, _ = at(w + length * way)
            if new <= value + 1e-4 * length * (way @ slope) or length < 1e-3:
                break
            length /= 3
        moved, turned = length * way, new_slope - slope
        if (curved := moved @ turned) > 1e-14:
            left = np.eye(size) - np.outer(moved, turned) / curved
            guess = left @ guess @ left.T + np.outer(moved, moved) / curved
        w, value, slope = w + moved, new, new_slope
    w = np.round(w, 6)
    return LineField(w[:FEATURES], w[FEATURES:].reshape(2, 2))


def _without_words() -> LineField:
    return LineField(np.array([1.0] + [0.0] * (FEATURES - 1)), np.zeros((2, 2)))


def fit_rows(texts: pa.Array, steps: int = STEPS) -> LineField:
    """The field of texts in memory, all of them; nulls are passed over."""
    texts = texts.drop_null()
    raw, offs = K.utf8(texts)
    _, h = short_lines(raw, K.lines(raw, offs)[:2])
    x, y, borders, worded = weak_labels(raw, offs, recurring(*np.unique(h, return_counts=True), len(texts)))
    return train(lambda w: line_sums(x, y, borders, w), steps) if worded else _without_words()


def fit(docs: DataFrame) -> LineField:
    """The field of all texts."""
    known = docs.where("text is not null").select("text")

    def count(batches):
        for batch in batches:
            for rows, data, offs in K.chunks(batch, "text", CHUNK):
                _, h = short_lines(data, K.lines(data, offs)[:2])
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([None, *h.view(np.int64).tolist()], pa.int64()), pa.array(np.append(rows.num_rows, n))], ["h", "n"])

    counts = save(known.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "short-lines")
    texts = counts.where("h is null").agg(F.sum("n")).collect()[0][0] or 0
    found = counts.where((F.col("h").isNotNull()) & (F.col("n") >= TIMES) & (PER * F.col("n") >= texts)).toArrow()
    often = recurring(found["h"].to_numpy().view(np.uint64), found["n"].to_numpy(), texts)

    def label(batches):
        for batch in batches:
            for _, data, offs in K.chunks(batch, "text", CHUNK):
                x, y, borders, worded = weak_labels(data, offs, often)
                cells = [pa.array([v.tobytes()], pa.binary()) for v in (x, y.astype(np.int8), np.diff(borders))]
                yield pa.RecordBatch.from_arrays([*cells, pa.array([worded])], ["x", "y", "size", "worded"])

    lines = save(known.mapInArrow(label, "x binary, y binary, size binary, worded boolean"), "weak-labels")

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches):
            held, n = [], 0

            def total() -> pa.RecordBatch:
                x, y, size = (np.concatenate([np.frombuffer(r[k].as_buffer(), kind) for r in held]) for k, kind in enumerate((np.float64, np.int8, np.int64)))
                out = line_sums(x.reshape(-1, FEATURES), y.astype(np.int64), np.concatenate([[0], np.cumsum(size)]), w)
                return pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["sums"])

            for batch in batches:
                for row in zip(*batch.columns, strict=True):
                    held.append(row)
                    n += len(row[1].as_buffer())
                    if n >= AT_ONCE:
                        yield total()
                        held, n = [], 0
            if held:
                yield total()

        got = lines.select("x", "y", "size").mapInArrow(run, "sums array<double>").collect()
        return np.array([math.fsum(column) for column in zip(*(r[0] for r in got), strict=True)])  # the same in any order

    field = train(sums) if lines.where("worded").limit(1).count() else _without_words()
    discard(counts, lines)
    return field


def base_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counted rules of every text."""
    w = K.words(data, offs)
    n = w.counts
    inside = ~K.SPACE[data]
    starts, ends, borders = K.lines(data, offs)
    row = np.repeat(np.arange(len(n)), np.diff(borders))
    held = K.per_span(inside, starts, ends) > 0
    key = K.mix(K.span_hash(data, starts[held], ends[held]) + row[held].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    dup = np.bincount(row[held], minlength=len(n)) - np.bincount(row[held][first], minlength=len(n))
    at, h = K.windows(w, 8)
    text_of = w.text_of
    h = K.mix(h + text_of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    repeat = np.zeros(len(n), np.int64)
    if len(twice):
        hit = np.zeros(len(w.starts) + 1, np.int64)
        hit[at[np.isin(h, twice)] + 1] = 1
        run = np.cumsum(hit)
        i = np.arange(len(w.starts))
        repeat = np.bincount(text_of[run[i + 1] - run[np.maximum(i - 7, 0)] > 0], minlength=len(n))
    return {
        "n_words": n,
        "word_chars": K.per_text(inside & ((data & 0xC0) != 0x80), offs),
        "n_symbols": K.per_text(_SYMBOL[data], offs),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
    }


def judge(docs: DataFrame, field: LineField, share: float = SHARE) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the content share of every text."""

    def run(batches):
        for batch in batches:
            for rows, data, offs in K.chunks(batch, "text", CHUNK):
                c = base_counts(data, offs)
                failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
                x, borders, chars, _ = line_features(data, offs)
                label = field.decode(x, borders)
                part = np.add.reduceat(chars * label, borders[:-1]) / np.maximum(np.add.reduceat(chars, borders[:-1]), 1)
                cols = [rows.column(0), *(pa.array(np.asarray(v, np.int64)) for v in c.values()), pa.array(failed), pa.array(~failed & (part >= share)), pa.array(part)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *c, "base_failed", "kept", "content_share"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double")
