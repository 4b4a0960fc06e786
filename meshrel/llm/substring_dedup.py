"""Substring dedup by difference-cover anchors.

A word goes if a window of ``WINDOW`` words covers it whose word sequence also
starts in a document of smaller id. Only anchors are exchanged at first: hashes
of ``WINDOW - PERIOD + 1`` words at positions whose remainder modulo ``PERIOD``
lies in ``COVER``. The cover's differences give every remainder, so two equal
windows anywhere share an anchor at the same offset within them. Anchors seen
in two documents are then extended: the windows that hold one are hashed in
full, exchanged, and the smallest document of each window keeps it.

Exchanges carry packed arrays, a row for each chunk of texts and bucket; each
bucket is one task of bounded size, as the number of buckets follows the input.
A sequence that one chunk repeats is sent once (the chunk answers its own
documents), so a passage that a third of all documents share arrives once from
each chunk. Buckets cut hash space, so an anchor is told by 32 bits beside its
bucket and a window by 64; anchors only propose, windows decide.

Defined cases: null and empty texts have no words. A row without an id keeps
all words and covers nothing. Rows that repeat an id are taken as one document
(equal rows). Fewer words than a window: nothing goes. Further columns are
ignored, or kept by ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import parts

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)  # a perfect difference set modulo 7
BUCKET_BYTES = 16 << 20  # text behind one bucket
CHUNK = 8 << 20

_PACKED = "bucket int, kind int, payload binary"


def _pack(docs: np.ndarray, pos: np.ndarray, h: np.ndarray | None) -> bytes:
    """Occurrences in order of document and position."""
    edge = np.flatnonzero(np.diff(docs, prepend=docs[:1] - 1 if len(docs) else docs)) if len(docs) else np.zeros(0, np.int64)
    runs = np.diff(np.append(edge, len(docs))).astype("<u4")
    step = np.diff(pos, prepend=0)
    step[edge] = pos[edge]
    ids = docs[edge]
    head = np.array([len(docs), len(edge), 0 if h is None else h.itemsize], "<i8")
    planes = step.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()  # byte planes compress well
    meta = zstandard.compress(np.diff(ids, prepend=np.int64(0)).astype("<i8").tobytes() + runs.tobytes() + planes, 1)
    return head.tobytes() + len(meta).to_bytes(8, "little") + meta + (b"" if h is None else h.tobytes())


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, k, width = np.frombuffer(payload, "<i8", 3)
    size = int.from_bytes(payload[24:32], "little")
    meta = zstandard.decompress(payload[32 : 32 + size])
    ids = np.cumsum(np.frombuffer(meta, "<i8", k))
    runs = np.frombuffer(meta, "<u4", k, 8 * k).astype(np.int64)
    step = np.frombuffer(meta, np.uint8, 4 * n, 12 * k).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)
    head = np.cumsum(runs) - runs
    total = np.cumsum(step)
    pos = total - np.repeat(total[head] - step[head], runs) if n else total
    h = np.frombuffer(payload, f"<u{width}", n, 32 + size) if width else np.zeros(0, np.uint32)
    return np.repeat(ids, runs), pos, h


def _rows(bucket: np.ndarray, kind: int, docs: np.ndarray, pos: np.ndarray, h: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Packed rows, one for each bucket."""
    if not len(docs):
        return
    order = np.lexsort((pos, docs, bucket))
    bucket, docs, pos = bucket[order], docs[order], pos[order]
    h = None if h is None else h[order]
    edge = np.append(np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)), len(bucket))
    payloads = [_pack(docs[a:b], pos[a:b], None if h is None else h[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]].astype(np.int32)), pa.array(np.full(len(payloads), kind, np.int32)), pa.array(payloads, pa.binary())], ["bucket", "kind", "payload"])


def _home(docs: np.ndarray, n: int) -> np.ndarray:
    """The bucket in which answers for a document meet."""
    return ((K.mix(docs.view(np.uint64)) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _send(key: np.ndarray, h: np.ndarray, bucket: np.ndarray, docs: np.ndarray, pos: np.ndarray, n: int, all_shared: bool) -> Iterator[pa.RecordBatch]:
    """Occurrences of a chunk: kind 0 to be compared, kind 1 answers already known here.

    all_shared: every occurrence of a sequence in two documents is an answer, and
    one of them goes on; else only those outside the smallest document are.
    """
    order = np.lexsort((pos, docs, key))
    k, d = key[order], docs[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    shared = (np.maximum.reduceat(d, first) != d[first])[group] if len(k) else new
    least = d == d[first][group] if len(k) else new
    answer = shared & (all_shared | ~least)
    go = ~shared | (new if all_shared else least)
    a, g = order[answer], order[go]
    yield from _rows(_home(docs[a], n), 1, docs[a], pos[a], None)
    yield from _rows(bucket[g], 0, docs[g], pos[g], h[g])


def _compare(rows: DataFrame, n: int, all_shared: bool) -> DataFrame:
    """Answers, packed by the home bucket of their documents."""

    def run(batches):
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            direct = []
            for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                got = _unpack(payload.as_py())
                (direct if kind else found).append(got)
            if direct:
                docs, pos = (np.concatenate([x[i] for x in direct]) for i in (0, 1))
                yield from _rows(_home(docs, n), 1, docs, pos, None)
        if not found:
            return
        docs, pos, h = (np.concatenate([x[i] for x in found]) for i in range(3))
        found.clear()
        order = np.lexsort((docs, h))
        k, d = h[order], docs[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        shared = (np.maximum.reduceat(d, first) != d[first])[group]
        hit = order[shared if all_shared else shared & (d != d[first][group])]
        yield from _rows(_home(docs[hit], n), 1, docs[hit], pos[hit], None)

    return rows.repartitionById(n, "bucket").mapInArrow(run, _PACKED)


def _by_document(answers: DataFrame, n: int) -> DataFrame:
    """doc_id and its positions (ascending, 32 bits each)."""

    def run(batches):
        found = [_unpack(p.as_py()) for batch in batches for p in batch.column(2)]
        if not found:
            return
        docs, pos = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        order = np.lexsort((pos, docs))
        docs, pos = docs[order], pos[order]
        keep = np.ones(len(docs), bool)
        keep[1:] = (docs[1:] != docs[:-1]) | (pos[1:] != pos[:-1])
        docs, pos = docs[keep], pos[keep].astype("<u4")
        edge = np.append(np.flatnonzero(np.diff(docs, prepend=docs[0] - 1)), len(docs))
        for a in range(0, len(edge) - 1, 4096):
            e = edge[a : a + 4097]
            yield pa.RecordBatch.from_arrays([pa.array(docs[e[:-1]]), pa.array([pos[x:y].tobytes() for x, y in zip(e[:-1], e[1:], strict=True)], pa.binary())], ["doc_id", "at"])

    return answers.repartitionById(n, "bucket").mapInArrow(run, "doc_id bigint, at binary")


def squeezed(docs: DataFrame) -> DataFrame:
    """doc_id and the compressed text, for exchanges."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raw, offs = K.utf8(batch.column(1))
            z = [packer.compress(raw[offs[i] : offs[i + 1]].tobytes()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], ["doc_id", "z"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, z binary")


def _open(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Chunks of a batch whose column ``at`` holds compressed texts."""
    opener = zstandard.ZstdDecompressor()
    for a in range(0, batch.num_rows, 1024):
        rows = batch.slice(a, 1024)
        texts = [opener.decompress(z.as_buffer()) for z in rows.column(at)]
        table = pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.large_binary())], [*rows.schema.names, "text"])
        yield from K.chunks(table, "text", CHUNK)


def removals(docs: DataFrame, window: int = WINDOW, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, at): the window starts of each document whose sequence a smaller document has."""
    if window < PERIOD:
        raise ValueError(f"window must be {PERIOD} words at least")
    spark = docs.sparkSession
    known = docs.where("doc_id is not null").select("doc_id", "text")
    size = known.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    n = max(parts(spark), -(-size // BUCKET_BYTES))
    anchor = window - PERIOD + 1

    def anchors(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            done = 0
            for rows, data, offs in K.chunks(batch, "text", CHUNK):
                own = ids[done : done + rows.num_rows]
                done += rows.num_rows
                w = K.words(data, offs)
                at, h = K.windows(w, anchor)
                text_of = w.text_of[at]
                pos = at - w.borders[text_of]
                good = np.isin(pos % PERIOD, COVER) & (w.counts[text_of] >= window)
                h, pos, text_of = h[good], pos[good], text_of[good]
                bucket = ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
                yield from _send(h, h.astype(np.uint32), bucket, own[text_of], pos, n, True)

    proposed = _by_document(_compare(known.mapInArrow(anchors, _PACKED), n, True), n)

    def extend(batches):
        for batch in batches:
            for rows, data, offs in _open(batch, 2):
                ids = rows.column(0).to_numpy()
                w = K.words(data, offs)
                at = [np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in rows.column(1)]
                counts = [len(x) for x in at]
                text_of = np.repeat(np.arange(len(at)), counts)
                start = np.concatenate(at) + w.borders[text_of]
                wanted = np.zeros(len(w.starts), bool)
                for back in range(PERIOD):
                    s = start - back
                    wanted[s[s >= w.borders[text_of]]] = True
                place, h = K.windows(w, window)
                _, h2 = K.windows(w, window, second=True)
                keep = wanted[place]
                place, h, h2 = place[keep], h[keep], h2[keep]
                text_of = w.text_of[place]
                bucket = ((h2 >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
                yield from _send(h ^ (h2 << np.uint64(1)), h, bucket, ids[text_of], place - w.borders[text_of], n, False)

    texts = squeezed(known) if texts is None else texts
    windows = proposed.join(texts, "doc_id").select("doc_id", "at", "z").mapInArrow(extend, _PACKED)
    return _by_document(_compare(windows, n, False), n)


def _covered(w: K.Words, starts: list[np.ndarray], window: int) -> np.ndarray:
    """Whether each word lies in a window that starts at one of its text's positions."""
    hit = np.zeros(len(w.starts) + 1, np.int64)
    for i, s in enumerate(starts):
        hit[w.borders[i] + s + 1] = 1
    run = np.cumsum(hit)
    i = np.arange(len(w.starts))
    return run[i + 1] - run[np.maximum(i + 1 - window, 0)] > 0


def _starts(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) if x.is_valid else np.zeros(0, np.int64) for x in column]


def _kept_texts(data: np.ndarray, w: K.Words, gone: np.ndarray) -> list[bytes]:
    """Each text's kept words joined by one space."""
    s, e = w.starts[~gone], w.ends[~gone]
    size = e - s + 1
    head = np.cumsum(size) - size
    total = int(size.sum())
    flat = np.full(total, 32, np.uint8)
    within = np.arange(total) - np.repeat(head, size)
    source = within + np.repeat(s, size)
    inside = within < np.repeat(size - 1, size)
    flat[inside] = data[source[inside]]
    kept = np.concatenate([[0], np.cumsum(~gone)])[w.borders]
    borders = np.append(head, total)[kept]
    return [flat[borders[i] : max(borders[i], borders[i + 1] - 1)].tobytes() for i in range(len(borders) - 1)]


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    texts = squeezed(docs)
    gone_at = removals(docs, window, texts.where("doc_id is not null"))

    def run(batches):
        for batch in batches:
            for rows, data, offs in _open(batch, 1):
                w = K.words(data, offs, hashed=False)
                gone = _covered(w, _starts(rows.column(2)), window)
                sha = [hashlib.sha256(t).hexdigest() for t in _kept_texts(data, w, gone)]
                removed = np.bincount(w.text_of[gone], minlength=rows.num_rows)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(w.counts), pa.array(removed), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = texts.join(gone_at, "doc_id", "left").select("doc_id", "z", "at")
    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all columns, with the kept words of changed texts joined by one space."""
    names = docs.columns
    at, text = "_meshrel_at", names.index("text")
    gone_at = removals(docs, window).withColumnRenamed("at", at)

    def run(batches):
        for batch in batches:
            for rows, data, offs in K.chunks(batch, "text", CHUNK):
                starts = _starts(rows.column(len(names)))
                w = K.words(data, offs, hashed=False)
                new = _kept_texts(data, w, _covered(w, starts, window))
                old = rows.column(text).to_pylist()
                texts = [new[i].decode() if len(starts[i]) else old[i] for i in range(len(old))]
                cols = list(rows.columns[: len(names)])
                cols[text] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.join(gone_at, "doc_id", "left").select(*names, at).mapInArrow(run, docs.schema)
