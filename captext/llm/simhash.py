"""SimHash near-duplicates by a segment-popcount embedding and a grid join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captext.llm.columns import set_aside
from captext.operators.components import connected_components
from captext.session import cut, scratch

SEED = 42
#: A fingerprint has 16 segments of 4 bits; a cell holds their bit counts, a hexadecimal digit each.
SEGMENTS = 16
#: Slots of a sketch, and bands of coarse slots whose agreement makes two texts candidates.
SLOTS = 512
BANDS = 32
ROWS = 4
#: Standard errors by which a sketch must fall short for its pair to be discarded: a pair at the threshold is lost with a chance of 1e-8.
SURE = 5.6
#: Members of a band key that meet each other in one group of rows at most (twice as many between two blocks), and comparisons planned for a partition.
BLOCK = 4096
WORK = 1 << 24


def fingerprint(text: bytes | None, shingle: int = 3, lower: bool = True) -> int:
    """64 bits, each set where more than half of the shingles' XXH64 values have it.

    Words are what ASCII white space parts; shingles overlap and repeats count.
    Fewer words than `shingle` make one shingle, no word gives 0.
    """
    from xxhash import xxh64_digest

    words = ((text or b"").lower() if lower else text or b"").split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        parts = [joined]
    else:
        stops = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], stops[:-shingle]))
        parts = [joined[a:b] for a, b in zip(starts.tolist(), (stops[shingle - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.frombuffer(b"".join(map(xxh64_digest, parts, repeat(SEED))), np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(parts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every whole text; null is empty."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def cell(fp: Column) -> Column:
    """Bit counts of the 16 segments, one to a hexadecimal digit."""
    ones = F.lit(0x1111111111111111)
    total = fp.bitwiseAND(ones)
    for shift in (1, 2, 3):
        total = total + F.shiftrightunsigned(fp, shift).bitwiseAND(ones)
    return total


def close_pairs(points: DataFrame) -> DataFrame:
    """Pairs (a, b) of the ids of points (id, distinct fp) whose fingerprints differ in 1 or 2 bits.

    The Manhattan distance of two cells is at most the fingerprints' Hamming
    distance, so only points in cells at distance 0, 1 or 2 meet: a point stands
    in its own cell, in those with one count more (up) and one less (down).
    Distance 0 meets own to own; 1 own to up; 2 up to up where the sums of the
    counts agree and up to down where they differ by two. Every meeting is then
    checked exactly. 33 rows a point are shuffled; Spark sizes them as one row,
    so the join isn't left to its choice, which may be to broadcast them.
    """
    one = lambda i: F.lit(1).cast("long") if i == 0 else F.shiftleft(F.lit(1).cast("long"), 4 * i)
    digit = lambda c, i: F.shiftrightunsigned(c, 4 * i).bitwiseAND(F.lit(15))
    own = F.col("own")
    places = [F.struct(own.alias("cell"), F.lit(0).alias("move"))]
    for i in range(SEGMENTS):
        places.append(F.when(digit(own, i) < 4, F.struct((own + one(i)).alias("cell"), F.lit(1).alias("move"))))
        places.append(F.when(digit(own, i) > 0, F.struct((own - one(i)).alias("cell"), F.lit(-1).alias("move"))))
    spread = points.withColumn("own", cell(F.col("fp"))).select("id", "fp", "own", F.explode(F.array_compact(F.array(*places))).alias("at")).select("id", "fp", "own", "at.cell", "at.move")
    a, b = spread.where("move >= 0").alias("a"), spread.alias("b")
    meets = F.expr(
        "a.cell = b.cell AND (a.move = 0 AND b.move = 0 AND a.fp < b.fp OR a.move = 1 AND b.move = 0"
        " OR a.move = 1 AND b.move = 1 AND a.fp < b.fp AND a.own <> b.own OR a.move = 1 AND b.move = -1)"
        " AND bit_count(a.fp ^ b.fp) <= 2"
    )
    return a.join(b.hint("merge"), meets).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def simhash_groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    docs needs doc_id and text. Documents link where their fingerprints differ
    in two bits or fewer; equal fingerprints, also those of empty and null texts,
    are one point, so copies make no pairs. component_id is the smallest doc_id
    reachable, itself included. Repeated rows stay; a null doc_id is no one's
    smallest unless all of its component's are null.
    """
    prints = cut(fingerprints(docs, shingle))
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = connected_components(close_pairs(points.where("id IS NOT NULL")), "a", "b")
    groups = points.join(found, points["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """The sorted XXH64 values of a text's shingles, as fingerprint() takes them; none without a word."""
    from xxhash import xxh64_digest

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], stops[:-shingle]))
    ends = (stops[shingle - 1 :] if len(words) >= shingle else stops[-1:]) - 1
    parts = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=False)]
    return np.frombuffer(b"".join(map(xxh64_digest, parts, repeat(SEED))), ">u8").astype(np.uint64)


def sketch(hashes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The least hash of each of SLOTS ranges, 16 bits of it (0: none), and keys of BANDS groups of coarser slots.

    A coarse slot without a hash takes the next one that has.
    """
    bits = np.uint64(64 - SLOTS.bit_length() + 1)
    h = np.sort(hashes)
    at = np.searchsorted(h, np.arange(SLOTS, dtype=np.uint64) << bits)
    least = h[np.minimum(at, len(h) - 1)]
    filled = (at < len(h)) & (least >> bits == np.arange(SLOTS, dtype=np.uint64))
    mixed = (least * np.uint64(0x9E3779B97F4A7C15)) ^ (least >> np.uint64(31))
    fine = np.where(filled, (mixed >> np.uint64(48)) | np.uint64(1), 0).astype("<u2")
    coarse = np.where(filled, mixed, ~np.uint64(0)).reshape(BANDS * ROWS, -1).min(1)
    some = np.flatnonzero(coarse != ~np.uint64(0))
    step = np.searchsorted(some, np.arange(len(coarse)))
    value = coarse[some[step % len(some)]]
    value = value + (step // len(some) + (some[step % len(some)] != np.arange(len(coarse)))).astype(np.uint64)
    weights = np.uint64(0xD6E8FEB86659FD93) * np.arange(1, 2 * ROWS, 2, dtype=np.uint64)
    keys = (value.reshape(BANDS, ROWS) * weights).sum(1) + np.arange(BANDS, dtype=np.uint64)
    return fine.tobytes(), keys ^ (keys >> np.uint64(29))


def _likely(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether each pair of sketch rows may be `least` similar: a shared share of slots, less SURE standard errors of SLOTS and 2 slots, reaches it."""
    shared, filled = ((x == y) & (x > 0)).sum(-1), ((x > 0) | (y > 0)).sum(-1)
    return shared + 2 >= (least - SURE * (least * (1 - least) / SLOTS) ** 0.5) * filled


def shortened(sketches: np.ndarray) -> np.ndarray:
    """Sketch rows as SLOTS / 16 unsigned longs, a hexadecimal digit a slot: 0 where it is empty, else 1 to 15."""
    digits = np.where(sketches > 0, sketches % 15 + 1, 0).astype(np.uint64).reshape(len(sketches), -1, 16)
    return (digits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(-1, dtype=np.uint64)


def _ones(x: np.ndarray) -> np.ndarray:
    """How many hexadecimal digits of each row aren't 0."""
    x = x | (x >> np.uint64(1))
    x = x | (x >> np.uint64(2))
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int64)


def _may_be(x: np.ndarray, y: np.ndarray, least: float, nx: int, ny: np.ndarray) -> np.ndarray:
    """Whether pairs of shortened() rows of nx and ny shingles may be `least` similar.

    Sets whose sizes differ by more can't be. At `least` a union has at most
    (nx + ny) / (1 + least) shingles, and the filled slots are a random part of it,
    drawn without putting back: the fewer are left out, the smaller the error of the
    shared share. Of different slots one in 15 looks equal, so the equal ones among
    those that are filled on both sides are counted back. A pair is discarded where
    it falls short by SURE standard errors and 2 slots.
    """
    filled, same = _ones(x | y), SLOTS - _ones(x ^ y)
    both = _ones(x) + _ones(y) - filled
    shared = (same - (SLOTS - filled) - both / 15) * 15 / 14
    left_out = np.maximum(0.0, 1 - filled * (1 + least) / (nx + ny))
    error = (filled * (least * (1 - least) * left_out + (1 - least) / 14)) ** 0.5
    return (np.minimum(nx, ny) >= least * np.maximum(nx, ny)) & (shared + 2 >= least * filled - SURE * error)


def _meet(key: int, ids: np.ndarray, comps: np.ndarray, blocks: np.ndarray, rows: np.ndarray, bands: np.ndarray, n: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of different components in one group of _block_pairs() that may be similar: across its two blocks, or all of one.

    A pair with several common keys counts in the first of its bands (a row's keys) only.
    """
    found = []
    band = int(np.argmax(bands[0] == key))
    first = np.flatnonzero(blocks == blocks.min())
    other = np.flatnonzero(blocks != blocks.min())
    for k, i in enumerate(first):
        rest = other if len(other) else first[k + 1 :]
        rest = rest[comps[rest] != comps[i]]
        if len(rest):
            rest = rest[_may_be(rows[i], rows[rest], least, n[i], n[rest])]
            for j in rest[(bands[rest] == bands[i]).argmax(1) == band]:
                found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return found


def _block_pairs(members: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of ids of different components under one key whose sketches don't exclude `least`.

    members: key, id, component; sketches: id, short (shortened()), bands, n (shingles). A key's members
    are dealt by hash to blocks of about BLOCK, each two of which meet in one group of
    rows, so a common key is shared out and its pairs are compared, but not made into
    rows. There are as many partitions as the comparisons ask for.
    """
    sizes = cut(members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", "n"))
    work = sizes.agg(F.sum(F.col("n").cast("double") ** 2)).first()[0] or 0.0
    dealt = members.join(sizes.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("own", "with")).withColumn("high", F.greatest("own", "with")).select("key", "low", "high", "own", "id", "component").join(sketches, "id")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in rows:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None and held.num_rows else table
            group = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("key", "low", "high")])
            starts = np.concatenate(([0], np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1))
            held = table.slice(starts[-1])
            yield _compared(table.slice(0, starts[-1]), starts)
        if held is not None:
            yield _compared(held, np.zeros(1, np.int64))

    def _compared(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        found: list[tuple[int, int]] = []
        if table.num_rows:
            ids, comps, own, keys, n = (table.column(c).to_numpy() for c in ("id", "component", "own", "key", "n"))
            slots, bands = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(table.num_rows, -1) for c, kind in (("short", "<u8"), ("bands", "<i8")))
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=False):
                if b > a + 1:
                    found += _meet(int(keys[a]), ids[a:b], comps[a:b], own[a:b], slots[a:b], bands[a:b], n[a:b], least)
        made = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], ["a", "b"])

    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(work / WORK) + 1)
    return dealt.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(run, "a long, b long").distinct()


def _alike(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of pairs (a, b) whose texts' sets of shingles have a Jaccard similarity of `least` or more.

    Only texts of a pair are shuffled, and hashed again here: they take less room than their hashes.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, x = None, np.empty(0, np.uint64)
        for batch in rows:
            good = []
            for ta, tb in zip(batch.column("ta"), batch.column("tb"), strict=True):
                if ta.as_py() != known:
                    known = ta.as_py()
                    x = np.unique(_hashes(known, shingle))
                y = np.unique(_hashes(tb.as_py(), shingle))
                both = len(np.intersect1d(x, y, assume_unique=True))
                every = len(x) + len(y) - both
                good.append(not every or both / every >= least)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    own = lambda name: texts.select(F.col("doc_id").alias(name), F.col("text").cast("binary").alias(f"t{name}"))
    some = own("a").join(pairs.select("a").distinct(), "a", "left_semi"), own("b").join(pairs.select("b").distinct(), "b", "left_semi")
    return pairs.join(some[1], "b").join(some[0], "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def under_shared_keys(firsts: DataFrame) -> DataFrame:
    """key, id, a: the rows of firsts (id, keys) under each key that several have, and the first of them.

    Spark sizes all BANDS keys of a row as one, so the join isn't left to its choice, which may be to broadcast them.
    """
    keyed = firsts.select("id", F.explode("keys").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(heads.hint("merge"), "key")


def near_copy_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Per document: doc_id and component_id, over links between texts whose shingles' Jaccard similarity is `least` or more.

    Candidates are fingerprints within two bits (close_pairs) and, for similar
    texts whose fingerprints differ more, each document with the first one that
    has a key of BANDS in common. Where that leaves members of a key in several
    groups, all of its members of different groups meet too (_block_pairs), so
    that no pair with a common key goes uncompared. All are checked by sketches of
    SLOTS slots, which only discard pairs that are clearly less similar, and then
    by the shingles of both whole texts (_alike). Equal sets of shingles are one
    point. Texts without a word are equal. A row with a null doc_id is alone.
    """

    from xxhash import xxh3_128_digest

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps, sets, fine, keys, short, sizes = [], [], [], [], [], []
            for t in batch.column("text").cast(pa.large_binary()).to_pylist():
                h = _hashes(t, shingle)
                if not len(h):
                    h = np.zeros(1, np.uint64)
                ones = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
                fps.append(int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True))
                own = np.unique(h)
                sets.append(xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                own, bands = sketch(h)
                fine.append(own)
                keys.append(bands.view(np.int64))
                short.append(shortened(np.frombuffer(own, "<u2").reshape(1, -1)).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64()), pa.array(sets, pa.binary()), pa.array(fine, pa.binary()), pa.array([k.tolist() for k in keys], pa.list_(pa.int64())), pa.array([k.astype("<i8").tobytes() for k in keys], pa.binary()), pa.array(short, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "fp", "h", "sketch", "keys", "bands", "short", "n"])

    def check(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            good = _likely(*(np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, SLOTS) for c in ("sa", "sb")), least)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, fp long, h binary, sketch binary, keys array<long>, bands binary, short binary, n long")
    path = scratch(docs.sparkSession, "sketches")
    found.write.parquet(path)
    found = docs.sparkSession.read.parquet(path)
    points = cut(found.groupBy("h").agg(F.min("doc_id").alias("id"), F.first("fp").alias("fp")))
    firsts = cut(found.join(points.select("id"), F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), "sketch", "keys", "bands", "short", "n"))
    keyed = under_shared_keys(firsts)
    pairs = keyed.where("a < id").select("a", F.col("id").alias("b"))
    one = points.groupBy("fp").agg(F.min("id").alias("id"))
    near = close_pairs(one).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    level = points.join(one.select("fp", F.col("id").alias("a")), "fp").where("a < id").select("a", F.col("id").alias("b"))
    pairs = cut(pairs.union(near).union(level).distinct())
    left, right = firsts.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), firsts.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    likely = cut(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"))
    linked = cut(_alike(likely, texts, shingle, least))
    joined = connected_components(linked, "a", "b")
    shared = keyed.join(joined, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    apart = shared.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    more = cut(_block_pairs(cut(shared.join(apart, "key")), firsts.select("id", "short", "bands", "n"), least))
    joined = connected_components(linked.union(_alike(more, texts, shingle, least)), "a", "b")
    groups = points.join(joined, F.col("id") == F.col("node"), "left").select("h", F.coalesce("component", "id").alias("component_id"))
    return found.select("doc_id", "h").join(groups, "h").select("doc_id", "component_id")


def first_of_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their group of near copies; rows without a doc_id stay. See near_copy_groups()."""
    plain, restored = set_aside(docs, "doc_id")
    gone = near_copy_groups(docs, shingle, least).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return restored(plain.join(gone, F.col("doc_id") == F.col("gone"), "left_anti"))
