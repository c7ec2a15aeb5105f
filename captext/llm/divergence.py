"""Source divergence audit: how the sources of a language differ in their terms, priced pair by pair in sparse merges."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captext.session import scratch

#: What probabilities are counted in, and what is added to every count.
UNIT = 1_000_000_000
ADDED = 2
#: Terms of a slice of a language's vocabulary, and sources of a tile: a pair task holds two tiles' counts of one slice.
SLICE = 4096
TILE = 8
#: Distinct terms that a counting task holds before it hands them on.
HELD = 500_000

#: ASCII letters in lower case, a space for all other ASCII; bytes of other characters as they are.
LETTERS = bytes(b if b > 127 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters, A-Z as a-z, and of all non-ASCII characters."""
    return text.translate(LETTERS).split()


def counted_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents with the term), summed by task: keys may come several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                k = len(n)
                words = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([df[w] for w in words], pa.int64())],
                    ["lang", "source", "term", "n", "df"],
                )
            held.clear()

        room = HELD
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
                n, df = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                words, before = terms(text.as_py()), len(n)
                n.update(words)
                df.update(set(words))
                room -= len(n) - before
                if room < 0:
                    yield from handed()
                    room = HELD
        yield from handed()

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term string, n long, df long")


def price(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * (count + ADDED) / total) in 64 bits, digits by thousands: exact for totals up to 9e15, of which no count + ADDED is more."""
    rest, whole = counts.astype(np.int64) + ADDED, np.zeros(len(counts), np.int64)
    whole, rest = rest // total, rest % total
    for _ in range(3):
        rest *= 1000
        whole, rest = whole * 1000 + rest // total, rest % total
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / (p + q)) of whole numbers up to some 1e9."""
    return (p - q) ** 2 // (p + q)


def merged_price(a: tuple, b: tuple, kept: int) -> int:
    """The divergence of two groups over all `kept` terms of a slice.

    A group is (sorted term ids, their p, p of a term that it lacks). The shorter
    ids gallop through the longer: terms of both meet there, the others are priced
    against the other group's absent p, and terms of neither all cost the same.
    """
    (ids, p, p0), (jds, q, q0) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    at = np.searchsorted(jds, ids)
    met = np.zeros(len(ids), bool)
    met[at < len(jds)] = jds[at[at < len(jds)]] == ids[at < len(jds)]
    alone = np.ones(len(jds), bool)
    alone[at[met]] = False
    both = divergence(p[met], q[at[met]]).sum()
    sides = divergence(p[~met], np.int64(q0)).sum() + divergence(q[alone], np.int64(p0)).sum()
    neither = kept - len(ids) - int(alone.sum())
    return int(both) + int(sides) + neither * int((p0 - q0) ** 2 // (p0 + q0))


def _pairs(frame: pd.DataFrame) -> pd.DataFrame:
    """lang, a, b, value of each unordered pair across two tiles, or within one, over one slice."""
    low, high = frame["low"].iloc[0], frame["high"].iloc[0]
    held = []
    for r in frame.sort_values("source").itertuples():
        empty = np.zeros(0, np.int64)
        ids, counts = (empty if x is None else np.asarray(x, np.int64) for x in (r.ids, r.counts))
        # Without kept terms nothing is priced; the total is 0 then.
        total = max(1, int(r.total))
        held.append((r.tile, r.source, (ids, price(counts, total), int(price(np.zeros(1, np.int64), total)[0]))))
    kept, out = int(frame["kept"].iloc[0]), []
    for i, (tile, source, one) in enumerate(held):
        for other_tile, other, two in held[i + 1 :]:
            if low == high or tile != other_tile:
                out.append((frame["lang"].iloc[0], source, other, merged_price(one, two, kept)))
    return pd.DataFrame(out, columns=["lang", "a", "b", "value"])


def _exact(n: str, total: str) -> Column:
    """price() of columns, by decimals."""
    return F.expr(f"1 + (cast({n} + {ADDED} AS decimal(27,0)) * cast({UNIT} AS decimal(10,0))) div cast({total} AS decimal(27,0))")


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: what tells each source from the others of its language.

    docs needs text, lang and source; nulls are ''. Terms are runs of ASCII letters
    (A-Z as a-z) and non-ASCII characters. A language keeps the V terms that
    `least_docs` of its documents have. A group (lang, source), and each language,
    gives each kept term p = 1 + floor(1e9 * (count + 2) / (N + 2 * V)), N being all
    its kept occurrences; f = floor((p - q)^2 / (p + q)).

    Part `pair` has a row for each ordered pair of a language's sources: item is the
    other source, value the sum of f over all kept terms (0 where none is kept). Part
    `term` has the `top` terms that the group uses more than the language does (count
    above 0, p > q), with f. Ranks start from 1 for each group and part, by value
    descending, then by the item's UTF-8 bytes.

    Each row is a document, so repeated rows count again; a group without terms has
    pairs and no terms. A language's vocabulary is cut into slices of about SLICE
    terms and its sources into tiles of about TILE, so that a task holds two tiles of
    one slice; its pairs are sums over slices. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    term = Window.partitionBy("lang", "term")
    sums = counted_terms(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    sums = sums.withColumn("lang_df", F.sum("df").over(term)).withColumn("lang_n", F.sum("n").over(term)).withColumn("first", F.col("source") == F.min("source").over(term))
    kept = _written(spark, "kept", sums.where(F.col("lang_df") >= least_docs).select("lang", "source", "term", "n", "lang_n", "first"))
    sizes = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = _written(spark, "groups", groups.select("lang", "source", (F.col("total") + ADDED * F.col("v")).alias("total"), (F.col("lang_total") + ADDED * F.col("v")).alias("lang_total"), "v"))

    langs = groups.groupBy("lang").agg(F.first("v").alias("v"), F.count("*").alias("n")).select("lang", F.greatest(F.ceil(F.col("v") / SLICE), F.lit(1)).alias("slices"), F.ceil(F.col("n") / TILE).alias("tiles"))
    slot = kept.where("first").join(langs, "lang").select("lang", "term", F.pmod(F.xxhash64("term"), "slices").alias("slice"))
    slot = _written(spark, "vocabulary", slot.withColumn("id", F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term"))))
    held = kept.select("lang", "source", "term", "n").join(slot, ["lang", "term"]).groupBy("lang", "slice", "source").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("at"))
    held = held.select("lang", "slice", "source", F.col("at.id").alias("ids"), F.col("at.n").alias("counts"))
    rows = groups.join(langs, "lang").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    rows = rows.join(slot.groupBy("lang", "slice").agg(F.count("*").alias("kept")), ["lang", "slice"], "left").na.fill(0, ["kept"]).join(held, ["lang", "slice", "source"], "left")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("source"), "tiles")).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("lang", "slice", F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high"), "tile", "source", "total", "kept", "ids", "counts")
    pairs = rows.groupBy("lang", "slice", "low", "high").applyInPandas(_pairs, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", both.alias("at"), "value").select("lang", "at.source", F.lit("pair").alias("part"), "at.item", "value")

    p, q = _exact("n", "total").alias("p"), _exact("lang_n", "lang_total").alias("q")
    over = kept.join(groups.drop("v"), ["lang", "source"]).select("lang", "source", "term", p, q).where("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).union(over.select("*", rank).where(F.col("rank") <= top))


def _written(spark, name: str, rows: DataFrame) -> DataFrame:
    path = scratch(spark, name)
    rows.write.parquet(path)
    return spark.read.parquet(path)


#: DuckDB SQL with the same rows.
SQL = rf"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
  t AS (SELECT k, lang, source, translate(unnest(w), '{ascii_uppercase}', '{ascii_lowercase}') AS term FROM d),
  v AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
  g AS (SELECT DISTINCT lang, source FROM d),
  o AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
  c AS (SELECT g.lang, g.source, v.term, coalesce(o.n, 0) AS n FROM g JOIN v ON v.lang = g.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = v.term),
  p AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // CAST(sum(n) OVER w + 2 * count(*) OVER w AS BIGINT) AS p FROM c WINDOW w AS (PARTITION BY lang, source)),
  l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
  q AS (SELECT lang, term, 1 + 1000000000 * (CAST(n AS BIGINT) + 2) // CAST(sum(n) OVER w + 2 * count(*) OVER w AS BIGINT) AS q FROM l WINDOW w AS (PARTITION BY lang)),
  f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
  r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT p.lang, source, 'term', p.term, (p - q) * (p - q) // (p + q) FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q),
  s AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
  SELECT lang, source, part, item, value, rank FROM s WHERE part = 'pair' OR rank <= 10"""
