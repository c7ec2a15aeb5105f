"""Goldens and properties of the operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from captext.functions import text as T
from captext.operators import fusion, lexicon, sequences
from captext.operators.components import connected_components
from captext.operators.prefix import with_starts
from captext.plans import views as V
from captext.streaming import fold, live, steps


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("column", "value", "expected"),
    [
        (T.normalise_key, "Hello,  World!", "hello world"),
        (T.lookalike_key, "Sold", "501d"),
        (T.join_hyphens, "recog-\n nition", "recognition"),
        (T.normalise_space, "a  b ,c.... d", "a b,c… d"),
        (T.trim_decimals, "1.500 and 2.00 and 10,000", "1.5 and 2 and 10,000"),
        (T.letters_between_digits, "1O2 3l4", "102 314"),
        (T.repair_homoglyphs, "tехt", "text"),
        (T.is_valid_text, "12:30 at noon", False),
        (T.is_valid_text, "We should go now.", True),
        (T.detect_language, "Привет", "ru"),
        (T.speaker, "[Guard] Halt!", "Guard"),
        (T.pause_marks, "Well, go.", "Well,<200> go.<500>"),
        (T.longest_ramp, "abcdxyz", 7),
        (T.strip_isolated_latin, "мама xy мыла", "мама мыла"),
        (T.normalise_key, None, None),
    ],
)
def test_text(spark, column, value, expected):
    assert one(spark, column, value) == expected


def test_components(spark):
    random.seed(5)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 3), (7, 7)]
    least = {x: x for e in edges for x in e if x is not None}
    for _ in range(100):
        for a, b in edges:
            if a is not None:
                least[a] = least[b] = min(least[a], least[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got and all(least[n] == c for n, c in got.items())
    assert {n for a, b in edges if a is not None and a != b for n in (a, b)} == set(got)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_starts(spark):
    rows = [(i * 3, i % 7) for i in range(10_000)]
    got = {r.k: r.start for r in with_starts(spark.createDataFrame(rows, "k long, v long").repartition(5), "k", "v", "start").collect()}
    total = 0
    for k, v in rows:
        assert got[k] == total
        total += v


def test_glued_words(spark):
    words = spark.createDataFrame([("thecat",), ("catdogs",), ("unknownword",), ("the",)], "word string")
    known = spark.createDataFrame([("the", 50), ("cat", 30), ("dogs", 10), ("t", 1), ("he", 1)], "word string, freq long")
    assert {tuple(r) for r in lexicon.split_glued(words, known).collect()} == {("thecat", "the cat"), ("catdogs", "cat dogs")}
    assert {r.word: r.parts for r in lexicon.longest_match(words, known).collect()}["thecat"] == "the cat"


def test_fuzzy_finds_every_word_in_reach(spark):
    random.seed(2)
    known = sorted({"".join(random.choices("abc", k=random.randrange(3, 7))) for _ in range(60)})
    asked = sorted({"".join(random.choices("abc", k=random.randrange(3, 7))) for _ in range(60)} - set(known))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    got = {r.word: r.dist for r in lexicon.fuzzy_lexicon(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame([(w, 5) for w in known], "word string, freq long")).collect()}
    assert got == {w: d for w in asked if (d := min(distance(w, k) for k in known)) <= 2}


def test_common_run():
    assert fusion.common_run("hello", "helo") == pytest.approx(0.6)
    assert fusion.common_run("abc", "abc") == 1 and fusion.common_run("", "a") == 0 and fusion.common_run("short", "much longer text") == 0


@pytest.mark.parametrize("step", [steps.TextChanges(), steps.Chunks(), steps.NewTexts()])
def test_stream_and_table_agree(spark, step):
    d = "/root/testdata/sf0.001"
    from captext.plans.stream_queries import capture_stream

    table = spark.read.parquet(f"{d}/conversations.parquet").withColumn("copy", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))))
    table = table.selectExpr("conv_id AS stream_id", "turn * 3 + copy AS seq", "conv_id * 3600000 + (turn * 3 + copy) * 600 AS t", "CASE WHEN copy = 0 THEN substr(text, 1, length(text) div 2) ELSE text END AS text")
    batch = fold.table_fold(table.repartition(3), "stream_id", ["t", "seq"], step)
    stream = live.folded(capture_stream(spark, d), "stream_id", ["t", "seq"], step)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))


def test_chunks_lose_no_word(spark):
    rows = spark.createDataFrame([(1, i, i * 600, f"w{i} and more, words {i}") for i in range(30)], "stream_id long, seq long, t long, text string")
    got = fold.table_fold(rows, "stream_id", ["t", "seq"], steps.Chunks()).collect()
    said = " ".join(r.text for r in sorted(got, key=lambda r: r.seq)).split()
    every = " ".join(f"w{i} and more, words {i}" for i in range(30)).split()
    assert said == every


def test_order_of_partitions_does_not_matter(spark):
    rows = V.captures(spark, "/root/testdata/sf0.001")
    a, b = (sorted(map(tuple, sequences.stable_runs(x).collect())) for x in (rows, rows.repartition(7)))
    assert a == b


def test_homoglyph_round_trip(spark):
    words = ["window", "report", "kitchen", "garden"]
    noisy = spark.createDataFrame([(w, w.translate(str.maketrans("aeopcxy", "аеорсху"))) for w in words], "clean string, raw string")
    assert {r.clean: r.fixed for r in noisy.select("clean", T.repair_homoglyphs(F.col("raw")).alias("fixed")).collect()} == {w: w for w in words}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
