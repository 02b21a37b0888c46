"""Pack documents into fixed-length sequences by shortest-pack-first over the length histogram.

Texts become pieces of at most `capacity` ids. The driver sees only the histogram of piece
lengths (at most `capacity` rows). It places lengths longest first, each into the packs with the
most space, as ranges of packs that look alike; the outcome is a table of slots: ranks a..b of a
length go to sequences s.. at an offset. Pieces find their slot by their rank among the pieces of
their length.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkspark.llm.shared import materialise
from chunkspark.llm.text import blocks

CAPACITY = 4096
END = 2
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long"


def plan_packs(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Slots (length, first rank, end rank, packs, first sequence, offset) for all pieces.

    The piece of rank r in a slot goes to sequence first + (r - rank) % packs, at offset
    + length * ((r - rank) // packs). Each step ends a length or moves a whole range of packs, so
    ranges number at most two for each length.
    """
    packs: list[tuple[int, int, int]] = []  # (-space, first sequence, number of packs)
    slots: list[tuple[int, int, int, int, int, int]] = []
    n = 0
    for length in sorted((k for k, v in histogram.items() if v), reverse=True):
        left, rank = histogram[length], 0
        while left:
            if not packs or -packs[0][0] < length:
                slots.append((length, rank, rank + left, left, n, 0))
                if capacity > length:
                    heapq.heappush(packs, (length - capacity, n, left))
                n += left
                break
            space, first, count = heapq.heappop(packs)
            space = -space
            after = -packs[0][0] if packs else 0
            each = max(1, min((space - after) // length, space // length, left // count))
            took = min(left, count)
            placed = took * each if took == count else took
            if took < count:
                each = 1
                heapq.heappush(packs, (-space, first + took, count - took))
            slots.append((length, rank, rank + placed, took, first, capacity - space))
            if space > length * each:
                heapq.heappush(packs, (length * each - space, first, took))
            rank += placed
            left -= placed
    return np.array(slots, dtype=np.int64).reshape(-1, 6)


def _pieces(path: str, capacity: int, end: int):
    def run(batches):
        from pyspark import TaskContext

        from chunkspark.llm.tokens import encoder

        part, code = TaskContext.get().partitionId(), encoder(path)
        seen = np.zeros(capacity + 1, np.int64).tolist()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, raw, offsets in blocks(batch.column(1)):
                ids, bounds = code.encode(raw, offsets)
                bounds = bounds.tolist()
                rows = []
                for i in range(b - a):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end)).astype("<u4")
                    n = len(own)
                    for start in range(0, n, capacity):
                        piece = own[start : start + capacity]
                        m = len(piece)
                        rows.append((keys[a + i], start, m, zlib.crc32(piece), n, part, seen[m]))
                        seen[m] += 1
                columns = zip(*rows, strict=True)
                types = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in PIECE.split(", ")])

    return run


def token_pieces(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of each row's ids (those of `path`, then `end`), cut at multiples of `capacity`."""
    return df.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_pieces(path, capacity, end), PIECE)


def _slot_of(slots):
    def run(batches):
        table = slots.value
        order = np.lexsort((table[:, 1], table[:, 0]))
        table = table[order]
        shift = np.int64(1) << np.int64(45)
        keys = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            length, rank = (col[n].to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            own = table[np.searchsorted(keys, length * shift + rank, "right") - 1] if len(length) else table[:0]
            past = rank - own[:, 1]
            packs = np.maximum(own[:, 3], 1)
            sequence, offset = own[:, 4] + past % packs, own[:, 5] + length * (past // packs)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(col[n] for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece, the end id alone. Repeated rows and rows with null ids are
    packed each for itself; an empty table gives no rows.
    """
    pieces = materialise(token_pieces(df, path, text, doc_id, capacity, end), "pieces")
    counts = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    slots = df.sparkSession.sparkContext.broadcast(plan_packs(histogram, capacity))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(_slot_of(slots), schema)
