"""State that expires, timers without a next row, rows in any order, streams that end, memory that stays."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from captext.operators import fusion, scan
from captext.plans import views as V
from captext.sources.memory import Memory
from captext.streaming import fold, joins, live, steps

SF = "/root/testdata/sf0.001"
ROWS = "stream_id long, seq long, t long, text string"
HOUR = 3_600_000


class Files:
    """A stream of files that a test writes one by one; each run goes on from the checkpoint."""

    def __init__(self, spark, folder, schema=ROWS):
        self.spark, self.folder, self.schema = spark, f"{folder}/in", schema
        self.n = 0
        self.put([])

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)


class Run:
    """A fold that runs again and again over Files; new() gives what a run added."""

    def __init__(self, spark, files, folder, step, delay, order=("t", "seq")):
        self.spark, self.folder, self.seen = spark, folder, []
        self.ends = live.Ends(spark)
        timed = files.stream().withColumn("_at", live.at(F.col(order[0])))
        self.out = fold.stream_fold(self.ends.until(timed, "_at", delay), "stream_id", list(order), step)

    def run(self):
        with live.rocks(self.spark):
            self.out.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start().awaitTermination()
        rows = sorted(map(tuple, self.spark.read.schema(self.out.schema).parquet(f"{self.folder}/out").collect()))
        new = [r for r in rows if r not in self.seen]
        self.seen = rows
        return new

    def states(self):
        """Keys with a step's state, by the state store."""
        return self.spark.read.format("statestore").option("stateVarName", "state").load(f"{self.folder}/state").count()


def test_an_idle_chunk_comes_before_the_next_row_of_its_stream(spark, tmp_path):
    files = Files(spark, tmp_path)
    run = Run(spark, files, tmp_path, steps.Chunks(), "0 seconds")
    files.put([(1, 0, 1000, "two words"), (2, 0, 1000, "alone")])
    assert run.run() == []
    # Stream 1 pauses; only stream 2 goes on.
    files.put([(2, 1, 8000, "and then more")])
    assert run.run() == [(1, 0, "two words")]
    files.put([(2, 2, 20_000, "later")])
    assert run.run() == [(2, 1, "alone and then more")]
    run.ends.write()
    assert run.run() == [(2, 2, "later")]
    assert run.states() == 0


def test_a_piece_is_cut_in_the_pause(spark, tmp_path):
    files = Files(spark, tmp_path, "stream_id long, seq long, t0 long, t1 long")
    run = Run(spark, files, tmp_path, steps.Cuts(), "0 seconds", ("t0", "seq"))
    files.put([(1, 0, 0, 1500), (2, 0, 0, 100)])
    files.put([(2, 1, 2000, 2100)])
    assert run.run() == [(1, 0, 0, 1500)]
    files.put([(2, 2, 2200, 12_000), (3, 0, 30_000, 30_100)])
    # The forced piece, and the rest after its pause; a short one waits for the end.
    assert run.run() == [(2, 2, 0, 8000), (2, 2, 8000, 12_000)]
    run.ends.write()
    assert run.run() == [(3, 0, 30_000, 30_100)]


def test_busy_until_a_timer(spark, tmp_path):
    files = Files(spark, tmp_path, "stream_id long, seq long, t long, busy long")
    run = Run(spark, files, tmp_path, steps.Admissions(1000), "0 seconds")
    files.put([(1, 0, 1000, 5000), (1, 1, 3000, 0), (1, 2, 6000, 0), (1, 3, 6900, None), (1, 4, 7000, 0), (2, 0, 10_000, 0)])
    run.ends.write()
    assert run.run() == [(1, 0, 1000), (1, 2, 6000), (1, 4, 7000), (2, 0, 10_000)]


def test_states_fall_after_their_time(spark, tmp_path):
    files = Files(spark, tmp_path)
    run = Run(spark, files, tmp_path, steps.TextChanges(ttl=1000, forget=60_000), "0 seconds")
    files.put([(k, 0, 1000, f"some text of {k}") for k in range(20)] + [(k, 1, 1500, f"Some text of {k}!") for k in range(20)])
    files.put([(99, 0, 2000, "the clock")])
    assert len(run.run()) == 21 and run.states() == 21
    # What a stream said is forgotten a second later, but for the last text; after a minute nothing of it is left.
    files.put([(99, 1, 90_000, "the clock goes on")])
    run.run()
    assert run.states() <= 1
    files.put([(3, 2, 91_000, "some text of 3"), (99, 2, 95_000, "and on")])
    assert (3, 2, "some text of 3") in run.run()


def test_a_text_is_new_again_after_its_time(spark):
    rows = [(1, 0, 0, "one two three"), (1, 1, 900, "one two three"), (1, 2, 1800, "two three"), (1, 3, 9000, "something else entirely"), (1, 4, 9500, "one two three"), (1, 5, 9600, "something else entirelyy"), (1, 6, 9700, "hm")]
    found = fold.table_fold(spark.createDataFrame(rows, ROWS), "stream_id", ["t", "seq"], steps.TextChanges())
    assert sorted(r.seq for r in found.collect()) == [0, 3, 4]


@pytest.mark.parametrize("step", [steps.TextChanges(), steps.Chunks(), steps.MaturingLines()])
def test_shuffled_batches_give_the_rows_of_the_table(spark, tmp_path, step):
    rng = random.Random(3)
    words = "alpha beta, gamma delta. echo foxtrot golf".split()
    rows = [(s, i, s * 50 + i * rng.choice([200, 700, 3000]) // 2, " ".join(rng.choices(words, k=rng.randint(1, 5)))) for s in range(4) for i in range(30)]
    want = sorted(map(tuple, fold.table_fold(spark.createDataFrame(rows, ROWS), "stream_id", ["t", "seq"], step).collect()))
    rng.shuffle(rows)
    files = Files(spark, tmp_path)
    for k in range(0, len(rows), 40):
        files.put(rows[k : k + 40])
    assert sorted(map(tuple, live.folded(files.stream(), "stream_id", ["t", "seq"], step).collect())) == want and want


def test_rows_beyond_the_delay_are_late(spark, tmp_path):
    files = Files(spark, tmp_path)
    run = Run(spark, files, tmp_path, steps.NewTexts(), "2 seconds")
    files.put([(1, 0, 10_000, "first")])
    run.run()
    files.put([(1, 1, 8500, "in time"), (1, 2, 7000, "too late")])
    run.run()
    run.ends.write()
    run.run()
    assert run.seen == [(1, 0, "first"), (1, 1, "in time")]


def test_a_stream_goes_on_after_a_stop(spark, tmp_path):
    """Runs of one file each give what one run over all gives."""
    files = Files(spark, tmp_path)
    run = Run(spark, files, tmp_path, steps.Chunks(), "10 minutes")
    rows = [(s, i, i * 2500, f"w{s} x{i}" + ("." if i % 4 == 3 else "")) for s in range(3) for i in range(9)]
    for k in range(0, len(rows), 9):
        files.put(rows[k : k + 9])
        run.run()
    run.ends.write()
    run.run()
    assert run.seen == sorted(map(tuple, fold.table_fold(spark.createDataFrame(rows, ROWS), "stream_id", ["t", "seq"], steps.Chunks()).collect()))


@pytest.mark.parametrize("most", [7, 1000])
def test_scans_by_ranges(spark, most):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c"]) if i % 50 else None, i, rng.random()) for i in range(400)] + [("only", 1000, 0.9)]
    table = spark.createDataFrame(rows, "k string, i long, x double")
    by = {k: sorted(r for r in rows if r[0] == k) for k in ("a", "b", "c", "only")}
    runs, moved = [], []
    for k, own in by.items():
        open_run, before = None, None
        for r in own:
            if r[2] > 0.4:
                open_run = (k, open_run[1] if open_run else r[1], r[1], (open_run[3] if open_run else 0) + 1)
            elif open_run:
                runs.append(open_run)
                open_run = None
            state = "high" if r[2] > 0.4 else "low"
            if state != before:
                moved.append((k, r[1], before))
            before = state
        if open_run:
            runs.append(open_run)
    assert sorted(map(tuple, scan.islands(table, "k", ["i"], F.col("x") > 0.4, most).select("k", "first", "last", "n").collect())) == sorted(runs)
    state = F.when(F.col("x") > 0.4, "high").otherwise("low")
    assert sorted(map(tuple, scan.changes(table, "k", ["i"], state, "before", most).select("k", "i", "before").collect())) == sorted(moved)
    assert scan.islands(table.limit(0), "k", ["i"], F.col("x") > 0.4).count() == 0


def test_null_values_change_too(spark):
    table = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 3, "x"), ("a", 4, None)], "k string, i long, v string")
    assert sorted((r.i, r.before) for r in scan.changes(table, "k", ["i"], F.col("v"), most=1).collect()) == [(1, None), (3, None), (4, "x")]


def test_alerts_over_many_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"s{rng.randint(0, 2)}", i, rng.choice(["up", "up", "down"])) for i in range(60)]
    files = Files(spark, tmp_path, "service string, ts long, state string")
    for k in range(0, 60, 13):
        files.put(rows[k : k + 13])
    found = live.alerts(files.stream(), "service", ["ts"], "state", f"{tmp_path}/alerts", f"{tmp_path}/state")
    want = scan.changes(spark.createDataFrame(rows, files.schema), "service", ["ts"], F.col("state"))
    assert sorted(map(tuple, found.select("service", "ts", "before").collect())) == sorted(map(tuple, want.select("service", "ts", "before").collect()))


SPOKEN = [(1, 0, 0, 1000, "good morning to you"), (1, 1, 5000, 6000, "so we go now"), (1, 2, 60_000, 61_000, "nobody wrote this"), (2, 0, 0, 3000, "other stream")]
SHOWN = [(1, 0, 500, "good morning to you all"), (1, 1, 900, "Good morning to you"), (1, 2, 5900, "we go now"), (1, 3, 6500, "after the voice"), (2, 0, 20_000, "nobody spoke here"), (3, 0, 1000, "no voice at all"), (1, 4, 3600, "just in the grace")]


def both_ways(spark, tmp_path):
    speech, shown = "stream_id long, seq long, t0 long, t1 long, text string", "stream_id long, seq long, t long, text string"
    files = Files(spark, f"{tmp_path}/a", speech), Files(spark, f"{tmp_path}/b", shown)
    for k in range(4):
        files[0].put(SPOKEN[k : k + 1])
        files[1].put(SHOWN[2 * k : 2 * k + 2])
    return spark.createDataFrame(SPOKEN, speech), spark.createDataFrame(SHOWN, shown), *(f.stream() for f in files)


def test_stream_joins_give_what_table_joins_give(spark, tmp_path):
    speech, shown, a, b = both_ways(spark, tmp_path)
    columns = ["stream_id", "seq", "fused", "text"]
    want = sorted(map(tuple, fusion.fuse_subtitles(speech, shown).select(*columns).collect()))
    assert sorted(map(tuple, joins.fused(spark, a, b).select(*columns).collect())) == want
    assert want == [(1, 0, True, "Good morning to you"), (1, 1, True, "we go now"), (1, 2, False, "nobody wrote this"), (2, 0, False, "other stream")]
    want = sorted((r.stream_id, r.seq) for r in fusion.silent_subtitles(shown, speech).collect())
    assert sorted((r.stream_id, r.seq) for r in joins.silent(spark, b, a).collect()) == want == [(1, 4), (2, 0), (3, 0)]
    played = shown.selectExpr("stream_id", "t AS t0", "t + 300 AS t1", "text")
    streamed = b.selectExpr("stream_id", "t AS t0", "t + 300 AS t1", "text")
    want = sorted((r.stream_id, r.seq) for r in fusion.without_echo(speech, played).collect())
    assert sorted((r.stream_id, r.seq) for r in joins.unechoed(spark, a, streamed).collect()) == want == [(1, 2), (2, 0)]


def test_memory_of_answers(spark, tmp_path):
    asked = []

    def provider(missing):
        rows = missing.collect()
        asked.append(sorted((r.lang, r.key) for r in rows))
        return spark.createDataFrame([(r.lang, r.key, None if r.key == "bad" else r.key.upper()) for r in rows], "lang string, key string, answer string")

    memory = Memory(spark, f"{tmp_path}/memory", ["lang", "key"], "lang string, key string, answer string")
    files = Files(spark, tmp_path, "seq long, lang string, key string")
    files.put([(0, "en", "a"), (1, "en", "bad"), (2, "en", "a")])
    files.put([(3, "en", "a"), (4, "de", "a"), (5, "en", "bad")])
    rows = sorted(map(tuple, memory.enrich(files.stream(), provider).select("seq", "answer", "hit").collect()))
    assert rows == [(0, "A", False), (1, "", False), (2, "A", False), (3, "A", True), (4, "A", False), (5, "", False)]
    assert sorted(map(tuple, memory.table().select("lang", "key", "answer").collect())) == [("de", "a", "A"), ("en", "a", "A")]
    # A batch that runs again adds nothing, and another run finds what this one learned.
    last = spark.createDataFrame([(3, "en", "a"), (4, "de", "a")], files.schema)
    before = memory.table().count()
    for _ in range(2):
        memory.answer(last, provider, 7)
    assert memory.table().count() == before and asked[-1] == []
    again = Memory(spark, f"{tmp_path}/memory", ["lang", "key"], "lang string, key string, answer string")
    assert [tuple(r) for r in again.answer(last, provider, 8).orderBy("seq").select("answer", "hit").collect()] == [("A", True), ("A", True)]


def test_contained_texts(spark, monkeypatch):
    rng = random.Random(2)
    base = ["".join(rng.choices("ab cde", k=rng.randint(1, 60))) for _ in range(150)]
    texts = sorted({*base, *(t[rng.randint(0, len(t) // 2) : rng.randint(len(t) // 2, len(t))] for t in base), "abc" * 300, "bcabca", "aaaaaaaa", "a" * 40, "日本語のテキスト", "これは日本語のテキストです", "x" * 5})
    want = sorted((a, b) for a in texts for b in texts if a != b and len(a) >= 5 and a in b)
    frame = spark.createDataFrame([(t,) for t in texts] * 2 + [(None,)], "line string")
    for block in (512, 4):
        monkeypatch.setattr(fusion, "BLOCK", block)
        assert sorted(map(tuple, fusion.contained_texts(frame, "line").collect())) == want
    assert len(want) > 100


@pytest.mark.parametrize("block", [512, 4])
def test_similar_groups(spark, monkeypatch, block):
    monkeypatch.setattr(fusion, "BLOCK", block)
    rng = random.Random(9)
    texts = set()
    for _ in range(12):
        base = "".join(rng.choices("abcdefgh ", k=rng.randint(20, 90)))
        texts |= {base[: len(base) - rng.randint(0, len(base) // 4)] + "".join(rng.choices("xyz", k=rng.randint(0, 6))) for _ in range(8)}
    texts = sorted(texts | {"lone text of its own", "z"})
    near = {t: {o for o in texts if o != t and fusion.common_run(t, o) >= 0.75} for t in texts}
    want = []
    for t in texts:
        reached, edge = {t}, [t]
        while edge:
            new = near[edge.pop()] - reached
            reached |= new
            edge += new
        want.append((t, len(near[t]), min(reached)))
    frame = spark.createDataFrame([(t,) for t in texts] * 2 + [(None,)], "line string")
    assert sorted(map(tuple, fusion.similar_groups(frame, "line", 0.75).collect())) == want and max(n for _, n, _ in want) > 3


def test_contained_lines(spark):
    from captext.operators.lines import explode_lines

    lines = explode_lines(V.table(spark, SF, "documents")).select("line").distinct()
    held = sorted(r.line for r in lines.collect())
    want = sorted((a, b) for a in held if len(a) >= 8 for b in held if len(b) > len(a) and a in b)
    assert sorted(map(tuple, fusion.contained_texts(lines, "line", 8).collect())) == want and want
