"""Benchmark passages in documents: a prefix-filtered set join of word shingles, in DataFrame operations only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captext.session import scratch

#: Between words: ASCII characters that are neither digits nor letters, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle.
SHINGLE = 3
#: Windows (or their shingles) that are broadcast at once, in rows of fixed size: some 25 MB. More are joined in blocks of so many.
BLOCK = 200_000


def _split(text: str) -> Column:
    """An empty string, the words of a text, and another empty string where it ends with a separator or has no word."""
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.split(F.concat(F.lit(" "), lower), SEPARATORS)


def _gram(words: list[Column]) -> Column:
    """Hash of a shingle; missing words behind a text's end count for nothing."""
    return F.xxhash64(*words)


def benchmark_windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """item_id (string), words, digest: each `width` consecutive words of the items, all words of shorter ones; texts without a word give none."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.array_remove(_split("text"), "").alias("all")).where(F.size("all") > 0)
    each = words.select("item_id", "all", F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - width, F.lit(0)))).alias("at"))
    each = each.select("item_id", F.slice("all", F.col("at") + 1, width).alias("words"))
    return each.withColumn("digest", F.sha2(F.concat_ws(" ", "words"), 256))


def window_grams(windows: DataFrame) -> DataFrame:
    """digest, width, at, gram: every shingle of every distinct window of windows (digest, words); a window of fewer words is one."""
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - SHINGLE, F.lit(0))), lambda at: _gram([F.get("words", at + i) for i in range(SHINGLE)]))
    return windows.dropDuplicates(["digest"]).select("digest", F.size("words").alias("width"), F.posexplode(grams).alias("at", "gram"))


def document_grams(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, sum (a hash of the text), split, n_words, at, gram: the shingles of `sizes` words at every word.

    Word `at` is split[at]; at = 0 is no word and stands once for each document.
    """
    held = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("sum"), _split("text").alias("split"))
    last = F.when(F.element_at("split", -1) == "", 2).otherwise(1)
    ahead = F.arrays_zip(*(F.slice("split", i + 1, 2**31 - 1).alias(f"w{i}") for i in range(SHINGLE)))
    each = held.select("doc_id", "sum", "split", (F.size("split") - last).alias("n_words"), F.posexplode(ahead).alias("at", "word"))
    grams = [_gram([F.col(f"word.w{i}") for i in range(size)]) for size in sizes]
    several = F.explode(F.when(F.col("at") == 0, F.array(grams[0])).otherwise(F.array(*grams)))
    return each.select("doc_id", "sum", "split", "n_words", "at", (several if len(grams) > 1 else grams[0]).alias("gram"))


def rarest_grams(docs: DataFrame, grams: DataFrame, sizes: list[int], block: int = BLOCK) -> DataFrame:
    """digest, width, at, gram: of each window the shingle that occurs least in docs (the first of several), as its prefix.

    A window is in a document only with all of its shingles, so a prefix of one is
    enough, and windows with a shingle that occurs nowhere are left out.
    """
    wanted = grams.select("gram").distinct()
    blocks = max(1, -(-wanted.count() // block))
    own = document_grams(docs, sizes).where("at > 0").select("gram")
    counts = None
    for i in range(blocks):
        some = own.join(F.broadcast(wanted.where(F.pmod("gram", F.lit(blocks)) == i)), "gram", "left_semi").groupBy("gram").count()
        counts = some if counts is None else counts.union(some)
    path = scratch(docs.sparkSession, "counts")
    counts.write.parquet(path)
    ranked = grams.join(docs.sparkSession.read.parquet(path), "gram", "left")
    least = ranked.groupBy("digest", "width").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "at", "gram")).alias("least"))
    return least.where("least.n > 0").select("digest", "width", "least.at", "least.gram")


def occurrences(docs: DataFrame, prefixes: DataFrame, sizes: list[int], block: int = BLOCK) -> DataFrame:
    """doc_id, sum, n_words and start, stop, digest: where windows stand in docs, and a row without them for each document.

    Shingles meet prefixes; the window must then lie within the document (position
    and length) and have the very words (by their SHA-256).
    """
    blocks = max(1, -(-prefixes.count() // block))
    prefixes = prefixes.select("digest", "width", F.col("at").alias("ahead"), F.col("gram").alias("prefix"), F.pmod(F.xxhash64("digest"), F.lit(blocks)).alias("block"))
    start = F.col("at") - 1 - F.col("ahead")
    inside = (F.col("at") > 0) & (start >= 0) & (start + F.col("width") <= F.col("n_words"))
    same = F.sha2(F.concat_ws(" ", F.slice("split", start + 2, F.col("width"))), 256) == F.col("digest")
    found = None
    for i in range(blocks):
        met = document_grams(docs, sizes).join(F.broadcast(prefixes.where(F.col("block") == i)), (F.col("gram") == F.col("prefix")) & inside & same, "left")
        met = met.where(F.col("digest").isNotNull() | (F.lit(i == 0) & (F.col("at") == 0)))
        met = met.select("doc_id", "sum", "n_words", start.alias("start"), (start + F.col("width")).alias("stop"), "digest")
        found = met if found is None else found.union(met)
    return found


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10, block: int = BLOCK) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    benchmark needs item_id and text. Words are what ASCII characters other than
    digits and letters part, with A-Z in lower case. A window is `width` words in a
    row of an item, or all words of a shorter one. n_hit counts the words of a
    document inside any occurrence of a window, n_items the items with an occurring
    window, items_sha256 is of their item_ids, sorted as strings and joined by
    commas (of nothing: of the empty string).

    A null text has no words. Repeated rows of docs each have their result, repeated
    item_ids are one item with the windows of all their texts, and windows of items
    without an item_id hit words but count as no item. Without an item nothing is
    hit; an empty docs gives an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    paths = scratch(spark, "windows"), scratch(spark, "prefixes"), scratch(spark, "occurrences")
    benchmark_windows(benchmark, width).write.parquet(paths[0])
    windows = spark.read.parquet(paths[0])
    grams = window_grams(windows)
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    rarest_grams(docs, grams, sizes, block).write.parquet(paths[1])
    occurrences(docs, spark.read.parquet(paths[1]), sizes, block).write.parquet(paths[2])
    found = spark.read.parquet(paths[2])
    rows = found.where("digest IS NULL").select("doc_id", "sum", "n_words")
    hits, key = found.where("digest IS NOT NULL"), ["doc_id", "sum"]
    spans = hits.groupBy(*key, "start").agg(F.max("stop").alias("stop"))
    before = F.max("stop").over(Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("stop") - F.greatest("start", F.coalesce("before", F.lit(0))), F.lit(0))
    cover = spans.withColumn("before", before).groupBy(*key).agg(F.sum(fresh).alias("n_hit"))
    named = windows.select("digest", "item_id").distinct()
    items = hits.select(*key, "digest").distinct().join(named, "digest").groupBy(*key).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    both = cover.join(items, F.expr("true") & cover["doc_id"].eqNullSafe(items["doc_id"]) & (cover["sum"] == items["sum"]), "left").select(cover["doc_id"].alias("_d"), cover["sum"].alias("_s"), "n_hit", "items")
    out = rows.join(both, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("sum") == F.col("_s")), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: DuckDB SQL with the same rows.
SQL = r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  v AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(greatest(len(w) - 9, 1)), lambda a: array_to_string(w[a + 1 : a + 10], ' '))) AS words FROM i WHERE len(w) > 0),
  g AS (SELECT k, n, unnest(range(len(w) - n + 1)) AS a, w FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n),
  h AS (SELECT k, a, g.n, item FROM (SELECT k, a, n, array_to_string(w[a + 1 : a + n], ' ') AS words FROM g) g JOIN v ON v.words = g.words AND v.n = g.n),
  c AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(a, a + n)) AS p FROM h) GROUP BY k),
  t AS (SELECT k, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM h GROUP BY k)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)"""
