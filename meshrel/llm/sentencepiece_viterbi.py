"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton of a model's pieces reads the normalised bytes once. At each
position the output links give every piece that ends there, longest first, and
each relaxes the best score of that position. Many word segments run side by
side in numpy, one byte at a time; a segment ends where no piece can cross (a
word mark after anything else), so cutting there changes no result.

Characters outside the pieces become byte pieces (or the unknown id where the
model has none). The score of a segmentation is the sum of its pieces' scores,
which is the unigram objective whatever kind of model the file names.

Defined cases: null and empty texts have no ids. A text that holds the word
mark itself decodes it to a space. Repeated rows are encoded alike; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

MARK = "▁".encode()
UNKNOWN_PENALTY = 10.0
CHUNK = 6 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Automaton:
    """Pieces of a model file, their automaton and output links."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap:
            raise ValueError("only models with identity normalisation are supported")
        self.dummy_prefix = model.normalizer_spec.add_dummy_prefix
        self.squeeze = model.normalizer_spec.remove_extra_whitespaces
        own = [(i, p.piece.encode(), p.score) for i, p in enumerate(model.pieces) if p.type in (1, 4)]
        self.bytes = np.full(256, -1, np.int32)
        self.unknown = 0
        self.surface: list[bytes] = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.surface[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 2:
                self.unknown = i
                self.surface[i] = b" \xe2\x81\x87 "
            elif p.type in (1, 4):
                self.surface[i] = p.piece.encode()
        self.unknown_score = min((s for _, _, s in own), default=0.0) - UNKNOWN_PENALTY
        #: whether a word mark after another character always starts a segment
        self.cuttable = all(MARK not in p or p == MARK * (len(p) // 3) or (p.startswith(MARK) and MARK not in p.lstrip(MARK)) for _, p, _ in own)
        children: list[dict[int, int]] = [{}]
        piece_at: list[int] = [-1]
        for k, (_, p, _) in enumerate(own):
            s = 0
            for b in p:
                nxt = children[s].get(b)
                if nxt is None:
                    nxt = children[s][b] = len(children)
                    children.append({})
                    piece_at.append(-1)
                s = nxt
            piece_at[s] = k
        n = len(children)
        self.goto = np.zeros((n, 256), np.int32)
        fail = np.zeros(n, np.int32)
        out = np.full(n, -1, np.int32)  # first state of the output chain, the state itself included
        self.link = np.full(n, -1, np.int32)  # next state of the chain
        queue = [0]
        for s in queue:
            if s:
                self.goto[s] = self.goto[fail[s]]
                self.link[s] = out[fail[s]]
                out[s] = s if piece_at[s] >= 0 else self.link[s]
            for b, t in children[s].items():
                fail[t] = self.goto[s, b] if s else 0
                queue.append(t)
            for b, t in children[s].items():
                self.goto[s, b] = t
        self.out = out
        at = np.array(piece_at)
        self.id = np.where(at >= 0, np.array([i for i, _, _ in own], np.int32)[at], -1)
        self.size = np.where(at >= 0, np.array([len(p) for _, p, _ in own], np.int32)[at], 0)
        self.score = np.where(at >= 0, np.array([s for _, _, s in own], np.float64)[at], 0)
        lens = np.array([len(x) for x in self.surface])
        self.surface_borders = np.concatenate([[0], np.cumsum(lens)])
        self.surface_data = np.frombuffer(b"".join(self.surface), np.uint8)

    def normalise(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word marks for spaces and before each text that is not empty."""
        if self.squeeze:
            texts = [b" ".join(x for x in data[a:b].tobytes().split(b" ") if x) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            data = np.frombuffer(b"".join(texts), np.uint8)
            offs = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        width = np.where(data == 32, 3, 1)
        full = np.diff(offs) > 0
        prefix = np.zeros(len(data), np.int64)
        if self.dummy_prefix:
            prefix[offs[:-1][full]] = 3
        step = width + prefix
        end = np.cumsum(step)
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
        begin = end - width
        out[begin[width == 1]] = data[width == 1]
        heads = np.concatenate([begin[width == 3], begin[prefix > 0] - 3])
        for k in range(3):
            out[heads + k] = MARK[k]
        borders = np.concatenate([[0], end])[offs]
        return out, borders

    def segments(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Starts of segments, the end of data included."""
        if not len(data):
            return np.zeros(1, np.int64)
        first = np.zeros(len(data), bool)
        first[offs[:-1][np.diff(offs) > 0]] = True
        if self.cuttable:
            mark = np.zeros(len(data), bool)
            mark[: len(data) - 2] = (data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])
            follows = np.zeros(len(data), bool)
            follows[3:] = mark[:-3]
            first |= mark & ~follows
        return np.append(np.flatnonzero(first), len(data))

    def viterbi(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments given longest first: flat ids and the number for each segment."""
        n, longest = len(starts), int(lens[0])
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0
        node = np.zeros((longest + 1, n), np.int32)  # the piece's state, or -(bytes of an unknown character)
        state = np.zeros(n, np.int32)
        char = np.zeros(n, np.int32)
        lane = np.arange(n)
        live = n
        for t in range(longest):
            live = int(np.searchsorted(-lens, -t, "left"))
            byte = data[starts[:live] + t]
            state = self.goto[state[:live], byte]
            lead = (byte & 0xC0) != 0x80
            char = np.where(lead, 1, char[:live] + 1)
            single = np.zeros(live, bool)
            o = self.out[state]
            at = lane[:live][o >= 0]
            o = o[at]
            row, node_row = best[t + 1], node[t + 1]
            while len(at):
                size = self.size[o]
                value = best[t + 1 - size, at] + self.score[o]
                up = value > row[at]
                row[at[up]] = value[up]
                node_row[at[up]] = o[up]
                single[at[size == char[at]]] = True
                o = self.link[o]
                more = o >= 0
                at, o = at[more], o[more]
            # a character ends here if the next byte leads or the segment is over
            over = lens[:live] == t + 1
            nxt = data[np.minimum(starts[:live] + t + 1, len(data) - 1)]
            alone = np.flatnonzero(~single & (over | ((nxt & 0xC0) != 0x80)))
            if len(alone):
                value = best[t + 1 - char[alone], alone] + self.unknown_score
                up = value > row[alone]
                row[alone[up]] = value[up]
                node_row[alone[up]] = -char[alone[up]]
        # back along the best nodes, all segments at once
        at = lens.astype(np.int64).copy()
        seg_out, pos_out, id_out = [], [], []
        alive = lane
        while len(alive):
            d = node[at[alive], alive]
            known = d > 0
            seg_out.append(alive[known])
            pos_out.append(at[alive[known]])
            id_out.append(self.id[d[known]])
            odd = alive[~known]
            size = np.where(known, self.size[np.maximum(d, 0)], -d)
            if len(odd):
                width = -d[~known]
                if self.bytes.min() >= 0:
                    for k in range(int(width.max())):
                        has = width > k
                        seg_out.append(odd[has])
                        pos_out.append(at[odd[has]] - width[has] + k + 1)
                        id_out.append(self.bytes[data[starts[odd[has]] + at[odd[has]] - width[has] + k]])
                else:
                    seg_out.append(odd)
                    pos_out.append(at[odd])
                    id_out.append(np.full(len(odd), self.unknown, np.int32))
            at[alive] -= size
            alive = alive[at[alive] > 0]
        seg, pos, ids = np.concatenate(seg_out), np.concatenate(pos_out), np.concatenate(id_out)
        order = np.argsort(seg * np.int64(longest + 1) + pos, kind="stable")
        return ids[order], np.bincount(seg, minlength=n)

    def encode_chunk(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of normalised texts and each text's border in them."""
        cuts = self.segments(data, offs)
        starts, lens = cuts[:-1], np.diff(cuts)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        _, first, same = np.unique(K.span_hash(data, starts, cuts[1:]), return_index=True, return_inverse=True)
        order = first[np.argsort(-lens[first], kind="stable")]
        slot = np.empty(len(first), np.int64)
        slot[np.argsort(-lens[first], kind="stable")] = np.arange(len(first))
        flat, number = [], []
        a = 0
        while a < len(order):  # groups of like length bound the score table
            longest = int(lens[order[a]])
            b = min(len(order), a + max(1, (2 << 20) // (longest + 1)))
            ids, count = self.viterbi(data, starts[order[a:b]], lens[order[a:b]])
            flat.append(ids)
            number.append(count)
            a = b
        ids, number = np.concatenate(flat), np.concatenate(number)
        heads = np.cumsum(number) - number
        which = slot[same]
        size = number[which]
        out_head = np.cumsum(size) - size
        total = int(size.sum())
        out = ids[np.arange(total) - np.repeat(out_head, size) + np.repeat(heads[which], size)]
        borders = np.append(out_head, total)[np.searchsorted(starts, offs)]
        return out, borders

    def decode_chunk(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the pieces, word marks as they are."""
        size = self.surface_borders[ids + 1] - self.surface_borders[ids]
        head = np.cumsum(size) - size
        total = int(size.sum())
        return self.surface_data[np.arange(total) - np.repeat(head, size) + np.repeat(self.surface_borders[ids], size)]

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        data, offs = self.normalise(raw, np.array([0, len(raw)], np.int64))
        return self.encode_chunk(data, offs)[0].tolist()

    def decode(self, ids: list[int]) -> str:
        raw = self.decode_chunk(np.asarray(ids, np.int64)).tobytes() if len(ids) else b""
        raw = raw.replace(MARK, b" ")
        return (raw[1:] if self.dummy_prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """Built once in each worker from the model file, which every machine has."""
    return Automaton(path)


def encode(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_ids, n_bytes (byte pieces), ids_crc32, round_trip and, if asked, the ids of every text.

    round_trip: decoding gives the normalised text again, byte for byte.
    """
    path = path or default_model()

    def run(batches):
        a = automaton(path)
        byte_piece = np.zeros(len(a.surface), bool)
        byte_piece[a.bytes[a.bytes >= 0]] = True
        for batch in batches:
            for rows, raw, offs in K.chunks(batch, "text", CHUNK):
                data, borders = a.normalise(raw, offs)
                ids, cuts = a.encode_chunk(data, borders)
                back = a.decode_chunk(ids.astype(np.int64))
                ends = np.concatenate([[0], np.cumsum(a.surface_borders[ids + 1] - a.surface_borders[ids])])[cuts]
                if len(back) == len(data) and (ends == borders).all():
                    same = K.per_text(back != data, borders) == 0
                else:
                    same = np.array([back[ends[i] : ends[i + 1]].tobytes() == data[borders[i] : borders[i + 1]].tobytes() for i in range(len(cuts) - 1)])
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[cuts[i] : cuts[i + 1]].tobytes()) for i in range(len(cuts) - 1)]
                cols = [rows.column(0), pa.array(np.diff(cuts)), pa.array(K.per_text(byte_piece[ids], cuts)), pa.array(crc, pa.int64()), pa.array(same)]
                names = ["doc_id", "n_ids", "n_bytes", "ids_crc32", "round_trip"]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id bigint, n_ids bigint, n_bytes bigint, ids_crc32 bigint, round_trip boolean" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give null."""
    path = path or default_model()

    def run(batches):
        a = automaton(path)
        for batch in batches:
            texts = [None if x is None else a.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
