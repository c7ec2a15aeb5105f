"""Sources mixed to target weights by pivotal dependent rounding."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captext.llm.columns import set_aside
from captext.operators.scan import ranged, with_total
from captext.session import cut, scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one task rounds, and buckets whose residuals meet in a task of the next level.
BUCKET_ROWS = 40_000
FAN_IN = 64
SEED = 7
#: Documents of a source that stay fractional until the last level, where flips among them make up for the last rounding.
RESERVE = 64

ROUNDED = "doc_id long, lot long, source string, size long, nth int, bucket int, base int, p double, u double, open boolean"


def word_count(text: str = "text") -> Column:
    """Words of a text between ASCII white space; none if null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of sizes (source, source_size): `share` of all sizes by weight, none above `most` times its source's size.

    Weights repeat over the sources in code-point order, null last. What a source
    can't take is shared again by weight among the others, round by round until none
    is above; a round sends two sums to the driver, however many sources there are.
    """
    placed = with_total(ranged(sizes.withColumn("_null", F.col("source").isNull()).withColumn("_one", F.lit(1)), "_one", ["_null", "source"]), "_one", ["_null", "source"], F.lit(1), "_place")
    weight = F.array(*(F.lit(float(w)) for w in weights))[F.pmod(F.col("_place") - 1, F.lit(len(weights))).cast("int")]
    rows = cut(placed.select("source", "source_size", weight.alias("_weight"), F.lit(None).cast("double").alias("target")))
    left = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    spent = 0.0
    while True:
        rest = F.col("target").isNull()
        total, n = rows.where(rest).agg(F.sum("_weight"), F.count("*")).first()
        if not n:
            break
        fair = F.lit(left - spent) * F.col("_weight") / F.lit(total)
        above = fair > most * F.col("source_size")
        if rows.where(rest & above).limit(1).count():
            rows = cut(rows.withColumn("target", F.when(rest & above, most * F.col("source_size")).otherwise(F.col("target"))))
            spent = float(rows.agg(F.sum("target")).first()[0])
            continue
        rows = rows.withColumn("target", F.coalesce("target", fair))
        break
    return rows.select("source", "source_size", "target")


def pivotal(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round probabilities p of items of positive size to 0 or 1 but for at most one: (p, its place or -1).

    The carried item and the next exchange mass, size times probability, at
    random and without bias until one of them is 0 or 1; the sum of size * p
    stays. Items follow each other from the largest down, so what is left is small.
    """
    p, draws = p.astype(float), rng.random(len(p))
    carry = -1
    for j in np.lexsort((np.arange(len(p)), -size)).tolist():
        if p[j] <= 0 or p[j] >= 1:
            continue
        if carry < 0:
            carry = j
            continue
        a, b, wa, wb = p[carry], p[j], size[carry], size[j]
        up, down = min((1 - a) * wa, b * wb), min(a * wa, (1 - b) * wb)
        if draws[j] * (up + down) < down:
            a, b = (1.0 if up == (1 - a) * wa else a + up / wa), (0.0 if up == b * wb else b - up / wb)
        else:
            a, b = (0.0 if down == a * wa else a - down / wa), (1.0 if down == (1 - b) * wb else b + down / wb)
        p[carry], p[j] = a, b
        carry = carry if 0 < a < 1 else j if 0 < b < 1 else -1
    return p, carry


def nearest(size: np.ndarray, p: np.ndarray, wanted: np.ndarray, most: int = 4 * RESERVE) -> np.ndarray:
    """Flip none, one or two of the first `most` rounded items so that sum(size * p) is nearest to sum(size * wanted)."""
    gap = float((size * (p - wanted)).sum())
    change = (size * (1 - 2 * p))[:most]
    pairs = np.abs(gap + change[:, None] + change[None, :])
    np.fill_diagonal(pairs, np.abs(gap + change))
    i, j = np.unravel_index(np.argmin(pairs), pairs.shape)
    if pairs[i, j] < abs(gap):
        p = p.copy()
        p[[i, j]] = 1 - p[[i, j]]
    return p


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, hash and any others) with `lot` and `nth`, which tell rows of one doc_id apart.

    Rows with a doc_id are one lot, numbered from 0 by size, source and hash; those
    without are a lot for each hash. No window is taken where each doc_id is there once.
    """
    lot = F.when(F.col("doc_id").isNull(), F.col("hash")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("lot", lot)
    if not rows.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count():
        return rows.withColumn("nth", F.lit(0))
    rank = Window.partitionBy("doc_id", "lot").orderBy("size", "source", "hash")
    return rows.withColumn("nth", (F.row_number().over(rank) - 1).cast("int"))


def copies(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """How often the mix takes each document: doc_id, lot, nth, source, size, source_size, target, copies.

    docs needs doc_id, text and source. Null texts have size 0, a null source is
    a source of its own, rows that share a doc_id are told apart by lot and nth (see
    _numbered()). A document's expected copies are its source's target over the
    source's size; the whole part is certain and the fraction is rounded by the
    pivotal method: in hash buckets, then residuals (at most one a bucket and
    source) and RESERVE documents of each source in a tree of FAN_IN buckets. In the
    last level a source's rows, at most FAN_IN * (RESERVE + 1), meet in a bucket by
    its hash; the last residual is rounded to the nearer side and one or two reserved
    documents flip where that brings the source nearer to its target. Documents of
    size 0 are rounded each by a hash. Reruns agree. Sources meet their targets in a
    join, so there may be as many as documents.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"), F.xxhash64("text").alias("hash"))
    rows = cut(_numbered(rows))
    path = scratch(docs.sparkSession, "targets")
    targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).write.parquet(path)
    facts = docs.sparkSession.read.parquet(path).withColumnRenamed("source", "of")
    rows = rows.join(facts, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).drop("of", "source_size", "target")
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        return rounded(frame, False)

    def finished(frame: pd.DataFrame) -> pd.DataFrame:
        return rounded(frame, True)

    def rounded(frame: pd.DataFrame, last: bool) -> pd.DataFrame:
        frame = frame.sort_values(["size", "doc_id", "lot", "nth"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        p, left = frame["p"].to_numpy(float).copy(), np.zeros(len(frame), bool)
        size, draw = frame["size"].to_numpy(), frame["u"].to_numpy()
        for source, at in frame.groupby("source", dropna=False, sort=False).indices.items():
            at = at[(size[at] > 0) & (p[at] > 0) & (p[at] < 1)]
            if not last:
                held = at[np.argsort(draw[at], kind="stable")[:RESERVE]]
                left[held] = True
                at = np.setdiff1d(at, held)
            if not len(at):
                continue
            name = "" if source is None or source != source else f"={source}"
            key = hashlib.blake2b(f"{SEED}/{frame['bucket'].iat[0]}/{last}/{len(frame)}/{name}".encode(), digest_size=8).digest()
            before = p[at].copy()
            p[at], carry = pivotal(size[at], p[at], np.random.default_rng(int.from_bytes(key, "little")))
            if last:
                p[at] = nearest(size[at], np.round(p[at]), before)
            elif carry >= 0:
                left[at[carry]] = True
        return frame.assign(p=p, open=left)

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame["times"].to_numpy(float)
        base = np.floor(f + 1e-12)
        frame = frame.assign(base=base.astype(np.int32), p=np.clip(f - base, 0, 1))
        zero = frame["size"] == 0
        frame.loc[zero, "p"] = (frame.loc[zero, "u"] < frame.loc[zero, "p"]).astype(float)
        return rounded(frame, False)[[c.split()[0] for c in ROUNDED.split(", ")]]

    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "lot", "nth"), F.lit(buckets)).cast("int"))
    keyed = keyed.withColumn("u", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "lot", "nth"), F.lit(1 << 30)) / float(1 << 30))
    level = cut(keyed.groupBy("bucket").applyInPandas(local, ROUNDED))
    settled = [level.where(~F.col("open"))]
    while True:
        final = buckets <= FAN_IN
        rest = level.where("open")
        if final:
            groups = max(1, -(-rest.count() // BUCKET_ROWS))
            rest = rest.withColumn("bucket", F.pmod(F.xxhash64("source"), F.lit(groups)).cast("int"))
        else:
            buckets = -(-buckets // FAN_IN)
            rest = rest.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("int"))
        level = cut(rest.groupBy("bucket").applyInPandas(finished if final else met, ROUNDED))
        settled.append(level.where(~F.col("open")))
        if final:
            break
    out = settled[0]
    for part in settled[1:]:
        out = out.union(part)
    return out.join(facts, F.col("source").eqNullSafe(F.col("of")), "left").select("doc_id", "lot", "nth", "source", "size", "source_size", "target", (F.col("base") + F.col("p").cast("int")).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted). See copies()."""
    return copies(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all its columns."""
    plain, restored = set_aside(docs, "doc_id", "text", "source")
    taken = copies(docs, **options).where("copies > 0").select(F.col("doc_id").alias("of"), F.col("lot").alias("of_lot"), F.col("nth").alias("of_nth"), "copies")
    numbered = _numbered(plain.withColumn("size", word_count()).withColumn("hash", F.xxhash64("text")))
    both = numbered.join(taken, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("lot") == F.col("of_lot")) & (F.col("nth") == F.col("of_nth")))
    return restored(both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))
