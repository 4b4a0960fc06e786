"""Best-fit packing of token sequences by a configuration linear program.

Documents are tokenised (closing id appended) and cut only if longer than
``CAPACITY``. The histogram of piece lengths (at most ``CAPACITY`` counts,
whatever the input) goes to the driver, where a covering program over
configurations (multisets of lengths that fit a sequence) is solved by
multiplicative weights; a knapsack dynamic program prices the configurations and
their dual gives a lower bound. The plan is a table of slots by length, and
each piece finds its slot by its rank among pieces of its length; ranks come
from counts of hashed shards, so that no task sees all pieces.

Defined cases: null and empty texts are one piece holding the closing id. Very
long texts are encoded whole and cut into pieces. Ties in rank go by id, then piece.
Repeated rows are packed one by one. An empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import save

CAPACITY = 1024
END_ID = 2
SHARD = 20_000
#: Fixed value: the splitting pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids of a byte-level BPE file, through the faster of two libraries that hold the same merges."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
        except BaseException as e:  # the fast library's native part panics on some extreme texts, with no class of its own to import
            if type(e).__name__ != "PanicException":
                raise
            return np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32. The first piece takes the odd rest."""
    path = path or default_vocabulary()

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                out: list[list] = [[], [], [], [], []]
                for doc, text in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                    text = text.as_py()
                    ids = np.append(encode(text) if text else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
                    at, k, size = 0, 0, len(ids) % capacity or capacity
                    while at < len(ids):
                        for col, v in zip(out, (doc, k, at, size, zlib.crc32(ids[at : at + size].tobytes())), strict=True):
                            col.append(v)
                        at, k, size = at + size, k + 1, capacity
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def _knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to the capacity, the most value that fits and the item taken last (-1: none, -2: look one lower)."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    for w in range(int(lengths[0]), capacity + 1):
        k = int(np.searchsorted(lengths, w, "right"))
        total = best[w - lengths[:k]] + value[:k]
        i = int(total.argmax())
        best[w], take[w] = total[i], i
        if best[w - 1] > best[w]:
            best[w], take[w] = best[w - 1], -2
    return best, take


def _chosen(lengths: np.ndarray, take: np.ndarray, room: int) -> dict[int, int]:
    """The items behind a room's best value; index -> times."""
    out: dict[int, int] = {}
    while room > 0 and take[room] != -1:
        i = int(take[room])
        if i == -2:
            room -= 1
            continue
        out[i] = out.get(i, 0) + 1
        room -= int(lengths[i])
    return out


def _fill(lengths: np.ndarray, rest: np.ndarray, room: int) -> dict[int, int]:
    """The items, as many of each as are left at most, whose sum comes closest to a room; larger ones are preferred."""
    fits = np.flatnonzero((rest > 0) & (lengths <= room))
    mask, reach, before = (1 << (room + 1)) - 1, 1, []
    for i in fits:  # sums that the items so far can make, as bits
        before.append(reach)
        n, step = min(int(rest[i]), room // int(lengths[i])), 1
        while n > 0:
            step = min(step, n)
            reach |= reach << (step * int(lengths[i])) & mask
            n, step = n - step, step * 2
    left, out = reach.bit_length() - 1, {}
    for i, lower in zip(fits[::-1], before[::-1], strict=True):
        a = min(int(rest[i]), left // int(lengths[i]))
        while not lower >> (left - a * int(lengths[i])) & 1:
            a -= 1
        if a:
            out[int(i)] = a
            left -= a * int(lengths[i])
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: number}) whose lengths are exactly those counted, in as few sequences as found."""
    return solve(counts, capacity)[0]


def solve(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = 200, rate: float = 0.2, eta: float = 0.004, tilt: float = 0.125, waste: int = 8) -> tuple[list[tuple[int, dict[int, int]]], float, int]:
    """The plan, a lower bound on the sequences of any plan, and how many of its sequences come from the program.

    Covering by multiplicative weights: a length's price starts at its share of a
    sequence (raised by up to ``tilt`` for long ones, which have fewest partners)
    and falls by a factor of exp(-eta * share covered). A knapsack over all rooms
    prices, for every length, the configuration of most value that holds it; those
    that leave no more room than the most valuable one and the slack are taken,
    each length moving by ``rate`` of its number a round at most. The slack grows,
    to ``waste`` tokens, once nothing moves. Times are whole, rounded down but to
    one where its pieces are there, and never cover more than is counted. By
    duality every round's prices bound the sequences from below: their total over
    the value of the best configuration. Pieces that the program leaves (rounding)
    are filled into sequences largest first, by exact subset sums.
    """
    out = [(counts[capacity], {capacity: 1})] if counts.get(capacity) else []
    whole = counts.get(capacity, 0)
    lengths = np.array(sorted(x for x, n in counts.items() if n and x < capacity), np.int64)
    if not len(lengths):
        return out, float(whole), whole
    need = np.array([counts[int(x)] for x in lengths], np.int64)
    rest = need.copy()
    used: dict[tuple[tuple[int, int], ...], int] = {}
    bound, slack, rng = 0.0, 0, np.random.default_rng(5)
    for _ in range(rounds):
        left = np.flatnonzero(rest > 0)
        if not len(left):
            break
        share = lengths[left] / capacity
        price = share * (1 + tilt * share) * np.exp(-eta * (1 - rest[left] / need[left]))
        best, take = _knapsack(lengths[left], price * (1 + 1e-6 * rng.random(len(left))), capacity)
        for y, top in ((price, best[-1]), (share, 1.0)):
            bound = max(bound, float(need[left] @ y) / (top * (1 + 1e-6)))
        allowed = np.maximum(1, rate * need[left]).astype(np.int64)
        least = capacity - sum(int(lengths[left][i]) * a for i, a in _chosen(lengths[left], take, capacity).items())
        moved = False
        for i in range(len(left) - 1, -1, -1):
            config = _chosen(lengths[left], take, capacity - int(lengths[left][i]))
            config[int(i)] = config.get(int(i), 0) + 1
            if capacity - sum(int(lengths[left][j]) * a for j, a in config.items()) > least + slack:
                continue
            if any(a > rest[left[j]] for j, a in config.items()):
                continue
            times = min(min(int(rest[left[j]]), max(int(allowed[j]), a)) // a for j, a in config.items())
            times = times if all(allowed[j] > 0 for j in config) else 0
            if times < 1:
                continue
            for j, a in config.items():
                rest[left[j]] -= times * a
                allowed[j] -= times * a
            key = tuple(sorted((int(left[j]), a) for j, a in config.items()))
            used[key] = used.get(key, 0) + times
            moved = True
        if not moved:
            slack = 2 * slack + 1
            if slack > waste:
                break
    program = sum(used.values())
    for key, times in used.items():
        out.append((times, {int(lengths[i]): a for i, a in key}))
    while (rest > 0).any():
        i = int(np.flatnonzero(rest > 0)[-1])
        rest[i] -= 1
        config = _fill(lengths, rest, capacity - int(lengths[i]))
        rest[i] += 1
        config[i] = config.get(i, 0) + 1
        times = min(int(rest[j]) // a for j, a in config.items())
        for j, a in config.items():
            rest[j] -= times * a
        out.append((times, {int(lengths[j]): a for j, a in config.items()}))
    return out, bound + whole, program + whole


def slots(sequences: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, number in a sequence, first sequence, offset) in order of rank."""
    table: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, config in sequences:
        offset = 0
        for length, a in sorted(config.items(), reverse=True):
            table.setdefault(length, []).append((taken.get(length, 0), a, sequence, offset))
            taken[length] = taken.get(length, 0) + times * a
            offset += length * a
        sequence += times
    return {k: np.array(v, np.int64) for k, v in table.items()}


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    pieces = save(cut(docs, path, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan(counts, capacity))
    shards = max(1, -(-sum(counts.values()) // SHARD))
    sharded = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    local = sharded.withColumn("_rank", F.row_number().over(Window.partitionBy("_shard", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    sizes = sharded.groupBy("length", "_shard").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = local.join(bases, ["length", "_shard"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_base")).alias("_rank"))

    def place(batches):
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                t = table[int(x)]
                s = t[np.searchsorted(t[:, 0], rank[rows], "right") - 1]
                q = rank[rows] - s[:, 0]
                sequence[rows] = s[:, 2] + q // s[:, 1]
                offset[rows] = s[:, 3] + q % s[:, 1] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
