"""Documents packed into token sequences by hierarchical residual best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captext.llm.encode import batches, encoder
from captext.session import cut

#: Bins that one task of a merging round takes as items.
GROUP = 50_000
#: Free places up to which a bin counts as nearly full and leaves the tree.
SLACK = 4
#: Fields of a member: doc_id, piece, start, length, crc32, 1 if doc_id is null.
FIELDS = 6

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
BINS = pa.schema([("fill", pa.int32()), ("members", pa.binary())])


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: lists of places in `sizes`, each list's sizes within capacity.

    Equal sizes keep their order. Bins are found by their free room: a bit for
    each room that some open bin has, so the tightest is the lowest bit from the
    item's size up.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _batch(fills: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(fills, pa.int32()), pa.array(blobs, pa.binary())], schema=BINS)


def _packed(fills: np.ndarray, blobs: list[bytes], capacity: int) -> Iterator[pa.RecordBatch]:
    bins = best_fit(fills, capacity)
    for k in range(0, len(bins), 10_000):
        part = bins[k : k + 10_000]
        yield _batch([int(fills[b].sum()) for b in part], [b"".join([blobs[i] for i in b]) for b in part])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0) -> DataFrame:
    """Pack the ids of all whole texts into sequences of at most `capacity` ids.

    docs needs doc_id and text; other columns are ignored, a null text is empty,
    a null doc_id stays null and repeated rows are packed each. A document is its
    ids and then end_id; only one longer than capacity is cut, into pieces of
    capacity after a shorter first one. With end_id None empty texts have no piece.

    Each input partition packs its own pieces by best fit; nearly full bins are
    done, the others become items of a next round over fewer, larger groups, down
    to one group or until a round no longer saves a bin. A bin holds at most
    `capacity` members, so its row is bounded; groups hold GROUP bins or so.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """

    def first(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        held_sizes: list[int] = []
        held: list[bytes] = []
        for batch, ids in batches(rows, enc):
            whole: list[bytes] = []
            for doc, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                x = np.concatenate((x.astype("<u4"), end)).astype("<u4")
                cuts = [0, *range(len(x) % capacity or capacity, len(x) + 1, capacity)] if len(x) else []
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    blob = np.array([doc or 0, piece, a, b - a, zlib.crc32(x[a:b].tobytes()), doc is None], "<i8").tobytes()
                    if b - a == capacity:
                        whole.append(blob)
                    else:
                        held_sizes.append(b - a)
                        held.append(blob)
            if whole:
                yield _batch([capacity] * len(whole), whole)
            if len(held) >= 4 * GROUP:
                yield from _packed(np.array(held_sizes), held, capacity)
                held_sizes, held = [], []
        yield from _packed(np.array(held_sizes, np.int64), held, capacity)

    def again(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(rows), BINS)
        yield from _packed(table.column("fill").to_numpy().astype(np.int64), table.column("members").to_pylist(), capacity)

    def unpack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            blobs = batch.column("members").to_pylist()
            m = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, FIELDS)
            counts = np.array([len(b) for b in blobs]) // (8 * FIELDS)
            total = np.cumsum(m[:, 3]) - m[:, 3]
            opens = np.cumsum(counts) - counts
            cols = [pa.array(m[:, 0], mask=m[:, 5] == 1), pa.array(m[:, 1].astype(np.int32)), *(pa.array(m[:, k]) for k in (2, 3, 4))]
            cols += [pa.array(np.repeat(batch.column("sequence_id").to_numpy(), counts)), pa.array(total - np.repeat(total[opens], counts) if len(m) else total)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = "fill int, members binary"
    bins = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, kind))
    done: list[DataFrame] = []
    full = F.col("fill") >= capacity - SLACK
    count, turn = bins.where(~full).count(), 0
    while count > 1:
        groups, turn = -(-count // GROUP), turn + 1
        done.append(bins.where(full))
        packed = cut(
            bins.where(~full)
            .withColumn("group", F.pmod(F.xxhash64(F.lit(turn), "members"), F.lit(groups)).cast("int"))
            .repartitionById(groups, F.col("group"))
            .sortWithinPartitions("members")
            .select("fill", "members")
            .mapInArrow(again, kind)
        )
        bins, before = packed, count
        made, count = bins.agg(F.count("*"), F.count_if(~full)).first()
        if groups == 1 or made == before:
            break
    done.append(bins)
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).mapInArrow(unpack, PIECES)
