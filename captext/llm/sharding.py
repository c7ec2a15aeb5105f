"""Shards of near equal bytes by a k-d tree over documents' metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captext.session import cut

LAW = "bytes"
#: Codes of a dimension at most.
CODES = 4096
DIMENSIONS = ("size_code", "lang_code", "source_code")
#: A cut goes on to finer keys until the bytes in doubt are below this share of a shard; copies of one text part beyond the second.
FINE = 0.0005
WHOLE = 0.5
#: Bytes, as a share of a shard, by which a cut may miss before the next widest dimension is tried.
MISS = 0.01
SLOT_ROWS = 200_000
#: Keys inside a dimension's code: groups of copies from the largest down, then bits of the text's hash (TEXT_KEYS so far), then of the row's.
KEYS = ("bulk", "text_a", "text_b", "text_c", "row_a", "row_b", "row_c")
TEXT_KEYS = 4


@dataclass
class Node:
    """A part of the tree that is to be cut: its shards and bytes, its dimensions from the widest on, the bytes its left part still lacks, and the keys where it ends so far."""

    shards: int
    total: float = 0.0
    widest: tuple[int, ...] = (0,)
    dim: int = 0
    goal: float = 0.0
    at: tuple[int, ...] = (0,)
    done: bool = True
    miss: float = 0.0
    best: tuple[float, int, tuple[int, ...]] | None = None


def _coded(rows: DataFrame, column: str) -> DataFrame:
    """rows with `{column}_code`: the place of the value among all values in order, or among CODES / 2 sampled ones if there are more; null is 0."""
    values = cut(rows.where(F.col(column).isNotNull()).select(column).distinct())
    n = values.count()
    sample = values if n < CODES else values.where(F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int(CODES / 2 / n * (1 << 30)))
    cuts = np.array(sorted(r[0] for r in sample.collect()), object)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"value": frame[column], "code": (np.searchsorted(cuts, frame[column].to_numpy(object), side="right") if len(cuts) else np.zeros(len(frame))).astype(np.int32) + (n >= CODES)})

    codes = values.mapInPandas(place, "value string, code int")
    return rows.join(codes, F.col(column) == F.col("value"), "left").withColumn(f"{column}_code", F.coalesce("code", F.lit(0))).drop("value", "code")


def _place(dim: Column) -> Column:
    """A row's place in the order of a dimension, as an array."""
    own = F.when(dim == 0, F.col(DIMENSIONS[0])).when(dim == 1, F.col(DIMENSIONS[1])).otherwise(F.col(DIMENSIONS[2]))
    return F.array(own, *KEYS)


def _cuts(rows: DataFrame, nodes: dict[int, Node], spread: list[float], shard_bytes: float) -> None:
    """Give each node of two shards or more its dimension and where its left part ends.

    One pass finds the dimension whose weighted variance, as a share of that of all
    rows, is the greatest; each further one settles one more key for all nodes. Where
    few large documents make a cut miss by more than MISS, the next widest dimension
    is tried, and the nearest cut taken. A row a node reaches the driver.
    """
    spark = rows.sparkSession
    own = rows.join(F.broadcast(spark.createDataFrame([(n,) for n in nodes], "node int")), "node")
    w = F.col("size").cast("double")
    moments = [f for d in DIMENSIONS for f in (F.sum(w * F.col(d)), F.sum(w * F.col(d) * F.col(d)))]
    for n, total, *sums in own.groupBy("node").agg(F.sum(w), *moments).collect():
        width = [(sums[2 * i + 1] / total - (sums[2 * i] / total) ** 2) / spread[i] if spread[i] > 0 else 0.0 for i in range(len(DIMENSIONS))]
        nodes[n].total, nodes[n].widest = total, tuple(int(i) for i in np.argsort(-np.round(width, 9), kind="stable"))
    for attempt in range(len(DIMENSIONS)):
        for x in nodes.values():
            if x.total and (attempt == 0 or x.best[0] > MISS * shard_bytes):
                x.dim, x.goal, x.at, x.done = x.widest[attempt], x.total * (x.shards // 2) / x.shards, (), False
        _settle(own, nodes, shard_bytes)
        for x in nodes.values():
            if x.total and (x.best is None or x.miss < x.best[0]):
                x.best = (x.miss, x.dim, x.at)
    for x in nodes.values():
        if x.best:
            _, x.dim, x.at = x.best


def _settle(own: DataFrame, nodes: dict[int, Node], shard_bytes: float) -> None:
    """Find the keys of all nodes that are not done, one a pass."""
    spark = own.sparkSession
    while open_nodes := {n: x for n, x in nodes.items() if not x.done}:
        depth = len(next(iter(open_nodes.values())).at)
        asked = spark.createDataFrame([(n, x.dim, list(x.at), x.goal) for n, x in open_nodes.items()], "node int, dim int, at array<int>, goal double")
        inside = own.join(F.broadcast(asked), "node").withColumn("place", _place(F.col("dim"))).where(F.slice("place", 1, depth) == F.col("at") if depth else F.lit(True))
        bars = inside.groupBy("node", "goal", F.col("place")[depth].alias("key")).agg(F.sum("size").alias("bytes"))
        packed = bars.groupBy("node", "goal").agg(F.array_sort(F.collect_list(F.struct("key", "bytes"))).alias("bars"))

        def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for node, goal, bars in zip(frame["node"], frame["goal"], frame["bars"], strict=True):
                    size = np.array([b["bytes"] for b in bars], float)
                    i = int(min(np.searchsorted(np.cumsum(size), goal), len(size) - 1))
                    out.append((node, bars[i]["key"], size[:i].sum(), size[i]))
                yield pd.DataFrame(out, columns=["node", "key", "before", "inside"])

        for r in packed.mapInPandas(found, "node int, key int, before double, inside double").collect():
            x = nodes[r["node"]]
            limit = WHOLE if depth == TEXT_KEYS else FINE
            x.goal -= r["before"]
            x.done = r["inside"] <= limit * shard_bytes or depth == len(KEYS)
            above = x.goal > r["inside"] / 2
            x.miss = abs(x.goal - r["inside"]) if above else abs(x.goal)
            x.at = (*x.at, r["key"] + int(x.done and above))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null).

    docs needs doc_id, text, lang and source; size is the text's UTF-8 bytes
    (null: none) plus 8. The tree starts with all rows for `shards` leaves (or as
    many as hold target_bytes each) and cuts each node at the weighted quantile of
    its widest dimension: the size's logarithm, the language or the source, in
    their order (null first), each measured by its weighted variance as a share of
    that of all rows. Where a code holds the cut, groups of equal texts from the
    largest down and bits of their hash decide; lang and source of equal texts are
    the least among them. So equal texts share a shard, unless they hold more than
    WHOLE of one: then bits of the doc_id's hash part them. Nodes of a level are
    cut together, and a row a node reaches the driver. slot numbers a shard's rows
    from 0 in doc_id order; rows equal in all count each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"), F.xxhash64(F.lit("row"), "doc_id").alias("row_hash"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
    )
    rows = cut(rows)
    copies = rows.groupBy("text_hash").agg(F.min("lang").alias("lang"), F.min("source").alias("source"), F.count("*").alias("n")).where("n > 1")
    copies = copies.select(F.col("text_hash").alias("of"), F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "n")
    several = F.col("n").isNotNull()
    rows = rows.join(copies, F.col("text_hash") == F.col("of"), "left").select(
        "doc_id", "size", "text_crc32", "text_hash", "row_hash", F.coalesce("n", F.lit(1)).alias("n"),
        F.when(several, F.col("of_lang")).otherwise(F.col("lang")).alias("lang"), F.when(several, F.col("of_source")).otherwise(F.col("source")).alias("source"),
    )
    bits = lambda name, shift: F.shiftrightunsigned(F.col(name), shift).bitwiseAND(F.lit(CODES - 1)).cast("int")
    rows = _coded(_coded(rows, "lang"), "source").select(
        "doc_id", "size", "text_crc32", F.floor(F.log(F.col("size").cast("double")) * 64).cast("int").alias("size_code"), "lang_code", "source_code",
        (-F.floor(F.log2(F.col("n") * F.col("size").cast("double")))).cast("int").alias("bulk"),
        *(bits("text_hash", shift).alias(k) for k, shift in zip(KEYS[1:4], (52, 40, 28), strict=True)), *(bits("row_hash", shift).alias(k) for k, shift in zip(KEYS[4:], (52, 40, 28), strict=True)),
        F.lit(0).alias("node"),
    )
    rows = cut(rows)
    w = F.col("size").cast("double")
    facts = rows.agg(F.sum("size"), *(f for d in DIMENSIONS for f in (F.sum(w * F.col(d)), F.sum(w * F.col(d) * F.col(d))))).first()
    total = facts[0] or 0
    spread = [facts[2 * i + 2] / total - (facts[2 * i + 1] / total) ** 2 if total else 0.0 for i in range(len(DIMENSIONS))]
    if shards is None:
        shards = max(1, -(-total // (target_bytes or 1 << 30)))
    counts = {0: int(shards)}
    while total and any(k > 1 for k in counts.values()):
        nodes = {n: Node(k) for n, k in counts.items() if k > 1}
        _cuts(rows, nodes, spread, total / shards)
        moves = rows.sparkSession.createDataFrame([(n, x.dim, list(x.at), n + x.shards // 2) for n, x in nodes.items()], "node int, dim int, at array<int>, right int")
        rows = rows.join(F.broadcast(moves), "node", "left")
        stays = F.col("right").isNull() | (_place(F.col("dim")) < F.col("at"))
        rows = cut(rows.withColumn("node", F.when(stays, F.col("node")).otherwise(F.col("right"))).drop("dim", "at", "right"))
        counts = {m: k for n, have in counts.items() for m, k in (((n, have // 2), (n + have // 2, have - have // 2)) if have > 1 else ((n, have),))}
    out = rows.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"))
    parts = max(1, -(-out.count() // SLOT_ROWS))
    ranged = cut(out.repartitionByRange(parts, "shard", "doc_id").sortWithinPartitions("shard", "doc_id", "text_crc32").withColumn("part", F.spark_partition_id()))
    begins: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    for r in ranged.groupBy("part", "shard").count().orderBy("part", "shard").collect():
        begins[r["part"], r["shard"]] = seen.get(r["shard"], 0)
        seen[r["shard"]] = seen.get(r["shard"], 0) + r["count"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: dict[tuple[int, int], int] = {}
        for batch in batches:
            part, shard = batch.column("part").to_numpy(), batch.column("shard").to_numpy()
            slot = np.zeros(batch.num_rows, np.int64)
            for s in np.unique(shard):
                own = np.flatnonzero(shard == s)
                key = (int(part[own[0]]), int(s))
                at = used.get(key, begins[key])
                slot[own] = at + np.arange(len(own))
                used[key] = at + len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(slot)], ["doc_id", "size", "text_crc32", "shard", "slot"])

    numbered = ranged.mapInArrow(number, "doc_id long, size long, text_crc32 long, shard int, slot long")
    return numbered.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
