"""Token-id shards compressed by Re-Pair grammars."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captext.llm.encode import batches, encoder, gather
from captext.operators.prefix import with_starts
from captext.session import scratch

#: Range partitions at most; each writes as many shards as its ids fill.
PARTITIONS = 20_000
#: Text bytes for which a range partition is planned, and ids that close a shard.
PARTITION_BYTES = 32 << 20
SHARD_IDS = 1 << 22
#: A pair becomes a rule if a round replaces it so often in the shard.
LEAST_USES = 24
#: Rules of a shard at most, more than LEAST_USES of each lets a shard have.
MOST_RULES = 1 << 20

SHARD = T.StructType(
    [
        T.StructField("part", T.IntegerType(), False),
        T.StructField("seq", T.IntegerType(), False),
        T.StructField("n_ids", T.LongType(), False),
        T.StructField("doc_ids", T.ArrayType(T.LongType(), True), False),
        T.StructField("doc_tokens", T.ArrayType(T.LongType(), False), False),
        T.StructField("doc_symbols", T.ArrayType(T.LongType(), False), False),
        T.StructField("first_rule", T.LongType(), False),
        T.StructField("rules", T.BinaryType(), False),
        T.StructField("lengths", T.BinaryType(), False),
        T.StructField("width", T.IntegerType(), False),
        T.StructField("symbols", T.BinaryType(), False),
    ]
)


#: Place of a shard in the whole order.
ORDER = "part * 2147483648L + seq"


def _pairs(seq: np.ndarray, at: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs as one number, where each one's places start, places) of the pairs that start at the places `at`, in the order of pair and place."""
    bits, room = np.uint64(n_symbols.bit_length()), np.uint64(len(seq).bit_length())
    key = seq[at].astype(np.uint64)
    key <<= bits
    key |= seq[at + 1]
    if 2 * int(bits) + int(room) <= 64:
        # A pair and its place in one number: sorting numbers is several times faster than ordering places by them.
        key <<= room
        key |= at.astype(np.uint64)
        key.sort()
        places = (key & np.uint64((1 << int(room)) - 1)).astype(np.int64)
        key >>= room
    else:
        order = np.argsort(key, kind="stable")
        key, places = key[order], at[order]
    starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
    return key[starts], starts, places


def _apart(places: np.ndarray, rule: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Which of the places, in order, are replaced: of two neighbours the less frequent pair gives way, what is left of a run alternates."""
    near = np.diff(places) == 1
    weaker = np.zeros(len(places), bool)
    own = strength[rule]
    weaker[1:] |= near & (own[1:] < own[:-1])
    weaker[:-1] |= near & (own[:-1] < own[1:])
    at = np.flatnonzero(~weaker)
    opens = np.concatenate((np.ones(min(1, len(at)), bool), np.diff(places[at]) != 1))
    run = np.arange(len(at)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
    out = np.zeros(len(places), bool)
    out[at[run % 2 == 0]] = True
    return out


def repair(ids: np.ndarray, last: np.ndarray, first_rule: int, most_rules: int, least: int = LEAST_USES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds: (symbols, marks of documents' last symbols, rules as rows of two symbols).

    A round counts adjacent pairs inside documents and replaces every pair found
    `least` times or more, from left to right without overlap, the more frequent
    of two overlapping pairs first where their runs meet. Rounds go on until no
    pair is found so often without overlap, or there are most_rules rules. After
    the first only pairs with a symbol of the round before are counted, and those
    that it left over: others can't have become more frequent. A rule's symbols
    are ids or earlier rules.
    """
    seq, last = ids.astype(np.uint32), last.copy()
    rules: list[np.ndarray] = []
    n_rules, at = 0, np.flatnonzero(~last[:-1])
    while len(at) and n_rules < most_rules:
        pairs, starts, places = _pairs(seq, at, first_rule + n_rules)
        counts = np.diff(np.append(starts, len(places)))
        keep = np.flatnonzero(counts >= least)
        if len(keep) > most_rules - n_rules:
            keep = np.sort(keep[np.argsort(-counts[keep], kind="stable")[: most_rules - n_rules]])
        if not len(keep):
            break
        pairs, counts, some = pairs[keep], counts[keep], np.zeros(len(counts), bool)
        some[keep] = True
        both = places[np.repeat(some, np.diff(np.append(starts, len(places))))] << 32 | np.repeat(np.arange(len(keep)), counts)
        both.sort()
        places, rule = both >> 32, both & 0xFFFFFFFF
        taken = _apart(places, rule, counts)
        good = np.bincount(rule[taken], minlength=len(pairs)) >= least
        if not good.any():
            # Pairs that only overlap each other: the most frequent one that is found often enough alone.
            grouped = np.split(np.argsort(rule, kind="stable"), np.cumsum(counts)[:-1])
            for k in np.argsort(-counts, kind="stable").tolist():
                own = grouped[k]
                alone = _apart(places[own], rule[own], counts)
                if alone.sum() >= least:
                    good[k], taken = True, np.zeros(len(places), bool)
                    taken[own[alone]] = True
                    break
            else:
                break
        taken &= good[rule]
        new = first_rule + n_rules
        gone = places[taken] + 1
        seq[places[taken]] = (new + np.cumsum(good) - 1)[rule[taken]]
        last[places[taken]] |= last[gone]
        look = np.zeros(len(seq), bool)
        look[places] = True
        stay = np.ones(len(seq), bool)
        stay[gone] = False
        seq, last, look = seq[stay], last[stay], look[stay]
        fresh = seq >= new
        look |= fresh
        look[:-1] |= fresh[1:]
        look &= ~last
        at = np.flatnonzero(look[:-1])
        bits = np.uint64((first_rule + n_rules).bit_length())
        made = pairs[good]
        rules.append(np.stack((made >> bits, made & np.uint64((1 << int(bits)) - 1)), 1).astype(np.uint32))
        n_rules += len(made)
    return seq, last, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)


def rule_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """How many ids each rule expands to."""
    out: list[int] = []
    for left, right in rules.tolist():
        out.append((out[left - first_rule] if left >= first_rule else 1) + (out[right - first_rule] if right >= first_rule else 1))
    return np.array(out, np.int64)


def expansions(rules: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray]:
    """All symbols' ids in a row and where each ends (0 first), for symbols below first_rule + len(rules)."""
    parts: list[np.ndarray] = []

    def of(symbol: int) -> np.ndarray:
        return parts[symbol - first_rule] if symbol >= first_rule else np.array([symbol], np.uint32)

    for left, right in rules.tolist():
        parts.append(np.concatenate((of(left), of(right))))
    flat = np.concatenate((np.arange(first_rule, dtype=np.uint32), *parts))
    return flat, np.concatenate((np.arange(first_rule + 1), first_rule + np.cumsum([len(p) for p in parts], dtype=np.int64)))


def _shard(part: int, seq: int, docs: list, held: list[np.ndarray], n_vocab: int) -> dict:
    tokens = np.array([len(x) for x in held], np.int64)
    ids = np.concatenate(held)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(tokens)[tokens > 0] - 1] = True
    symbols, ends, rules = repair(ids, last, n_vocab, MOST_RULES)
    cut = np.zeros(len(tokens), np.int64)
    cut[tokens > 0] = np.diff(np.append(0, np.flatnonzero(ends) + 1))
    width = 2 if n_vocab + len(rules) <= 1 << 16 else 4
    return {
        "part": part, "seq": seq, "n_ids": len(ids), "doc_ids": docs, "doc_tokens": tokens.tolist(), "doc_symbols": cut.tolist(), "first_rule": n_vocab,
        "rules": rules.astype("<u4").tobytes(), "lengths": rule_lengths(rules, n_vocab).astype("<u4").tobytes(), "width": width, "symbols": symbols.astype(f"<u{width}").tobytes(),
    }


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None) -> None:
    """Write the ids of every whole text as Re-Pair shards below `path`, in ascending doc_id order.

    docs needs doc_id and text; other columns are ignored. A null text is empty;
    a null doc_id comes first; rows with one doc_id follow each other in the
    order of their ids. A shard is one Parquet row: the documents' numbers of
    ids and symbols, the rules, the length that each rule expands to, and the
    symbols in 2 or 4 bytes. Spark's commit protocol covers lost executors.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    parts = int(min(PARTITIONS, max(1, -(-size // PARTITION_BYTES))))
    bounds: list[int] = []
    if parts > 1:
        at = [i / parts for i in range(1, parts)]
        bounds = sorted(docs.agg(F.percentile_approx("doc_id", at, 100 * min(parts, 1000))).first()[0] or [])

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([] if end_id is None else [end_id], enc.dtype)
        cuts = np.array(bounds, np.int64)
        for batch, ids in batches(rows, enc):
            doc = batch.column("doc_id")
            part = np.searchsorted(cuts, doc.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), doc, pa.array([np.concatenate((x, end)).tobytes() for x in ids], pa.binary())], ["part", "doc_id", "ids"])

    def compress(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        names, held, n, part, seq = [], [], 0, 0, 0
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("doc_symbols", pa.list_(pa.int64())), ("first_rule", pa.int64()), ("rules", pa.binary()), ("lengths", pa.binary()), ("width", pa.int32()), ("symbols", pa.binary())])
        vocab = max(enc.tokenizer.get_vocab_size(), (end_id or 0) + 1)
        for batch in rows:
            for p, doc, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True):
                part = p
                names.append(doc)
                held.append(np.frombuffer(ids, enc.dtype))
                n += len(held[-1])
                if n >= SHARD_IDS:
                    yield pa.RecordBatch.from_pylist([_shard(part, seq, names, held, vocab)], schema)
                    names, held, n, seq = [], [], 0, seq + 1
        if held:
            yield pa.RecordBatch.from_pylist([_shard(part, seq, names, held, vocab)], schema)

    (
        docs.mapInArrow(encode, "part int, doc_id long, ids binary")
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("doc_id", "ids")
        .mapInArrow(compress, SHARD)
        .write.option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The shards below `path`; `shard` orders them."""
    return spark.read.schema(SHARD).parquet(path).withColumn("shard", F.expr(ORDER))


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """Per shard: shard and start, the number of ids before it."""
    shards = read_tokens(spark, path).select("shard", "n_ids")
    return with_starts(shards, "shard", "n_ids", "start").select("shard", "start")


def decoded(row: dict) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a shard as (doc_id, ids)."""
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    flat, ends = expansions(rules, row["first_rule"])
    symbols = np.frombuffer(row["symbols"], f"<u{row['width']}").astype(np.int64)
    ids, _ = gather(flat, ends, symbols)
    at = 0
    for doc, n in zip(row["doc_ids"], row["doc_tokens"], strict=True):
        yield doc, ids[at : at + n]
        at += n


def decode_slice(row: dict, doc: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of the shard's document number `doc`: only the symbols that cover them are expanded."""
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    first = row["first_rule"]
    begin = sum(row["doc_symbols"][:doc])
    symbols = np.frombuffer(row["symbols"], f"<u{row['width']}", row["doc_symbols"][doc], begin * row["width"]).astype(np.int64)
    lengths = np.ones(len(symbols), np.int64)
    rule = symbols >= first
    lengths[rule] = np.frombuffer(row["lengths"], "<u4")[symbols[rule] - first]
    ends = np.cumsum(lengths)
    a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
    out: list[int] = []
    stack = symbols[a:b][::-1].tolist()
    while stack:
        s = stack.pop()
        if s >= first:
            stack += [int(rules[s - first][1]), int(rules[s - first][0])]
        else:
            out.append(s)
    skip = start - (int(ends[a - 1]) if a else 0)
    return np.array(out[skip : skip + max(0, stop - start)], np.uint32)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards below `path`: doc_id, start, n_tokens, ids_crc32, and the shard it is in."""

    def digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                n, crc, names = [], [], []
                for doc, ids in decoded(row):
                    names.append(doc)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                starts = np.cumsum([0, *n])[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array([row["shard"]] * len(n), pa.int64())], ["doc_id", "place", "n_tokens", "ids_crc32", "shard"])

    inside = read_tokens(spark, path).mapInArrow(digest, "doc_id long, place long, n_tokens long, ids_crc32 long, shard long")
    return inside.join(shard_starts(spark, path), "shard").select("doc_id", (F.col("start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "shard")


def token_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write `docs` with write_tokens (below the shared folder unless given) and return token_digest of what was read back."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return token_digest(spark, path)
