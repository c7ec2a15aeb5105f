"""Queries and operators without SQL against plain versions written anew."""

from __future__ import annotations

import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from captext.functions import text as T
from captext.operators import cleaning, fusion, lexicon, scoring, sequences
from captext.plans import registry
from captext.plans import views as V
from captext.sources import files
from captext.sources.memory import Memory
from captext.streaming import fold, joins, live, steps

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()
TEXTS = "stream_id long, seq long, text string"


def rows_of(spark, name):
    return QUERIES[name](spark, SF).collect()


def by_stream(rows, key="stream_id", order=("t", "seq")):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: tuple(r[c] for c in order)):
        out[r[key]].append(r)
    return out


@pytest.fixture(scope="module")
def halves(spark):
    """The captures that the streams see: half of a text, then the whole of it twice."""
    found = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    make = type("Row", (dict,), {"__getattr__": dict.__getitem__})
    return [make(stream_id=r.conv_id, seq=r.turn * 3 + k, t=r.conv_id * 3600000 + (r.turn * 3 + k) * 600, text=r.text[: len(r.text) // 2] if k == 0 else r.text) for r in found for k in range(3)]


def lcs(a, b):
    """Longest common substring by the table of all pairs."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def alike(a, b):
    return 0.0 if not a or not b or abs(len(a) - len(b)) > 0.3 * max(len(a), len(b)) else lcs(a, b) / max(len(a), len(b))


def test_common_run_by_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(0, 14))) for _ in range(2))
        assert fusion.common_run(a, b) == pytest.approx(alike(a, b))
        least = rng.choice((0.5, 0.75, 0.9))
        assert (fusion.common_run(a, b, least) >= least) == (alike(a, b) >= least)


def test_near_lines_lose_none(spark, monkeypatch):
    """All pairs of short and long texts, edited here and there, also with blocks of a few rows."""
    rng = random.Random(2)
    texts = set()
    for _ in range(40):
        base = "".join(rng.choices("abcdefgh é", k=rng.choice((1, 3, 4, 6, 9, 15, 40, 120))))
        texts.add(base)
        for _ in range(3):
            at = rng.randrange(len(base))
            texts.add(rng.choice((base[:at] + "xy" + base[at:], base[: at // 4] + base, base[at // 5 :], base + "zz")))
    texts = sorted(x for x in texts if x)
    want = {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if alike(a, b) >= 0.75}
    table = spark.createDataFrame([(x,) for x in texts], "line string")
    assert {(r.a, r.b) for r in fusion.similar_texts(table, "line", 0.75).collect()} == want and len(want) > 60
    monkeypatch.setattr(fusion, "BLOCK", 3)
    assert {(r.a, r.b) for r in fusion.similar_texts(table, "line", 0.75).collect()} == want


def test_hysteresis(spark):
    frames = by_stream(V.frames(spark, SF).collect(), order=("seq",))
    inner = {r * 8 + c for r in range(2, 6) for c in range(2, 6)}
    want = set()
    for stream, rows in frames.items():
        base = None
        for r in rows:
            luma = [0.0 if i in inner else v for i, v in enumerate(r.luma)]
            diff = 255.0 if base is None else sum(abs(x - y) for x, y in zip(luma, base, strict=True)) / 48
            moved = diff > 8
            base = luma if moved else base
            want.add((stream, r.seq, diff, moved))
    got = {(r.stream_id, r.seq): r for r in rows_of(spark, "w3_hysteresis")}
    assert len(got) == len(want)
    for stream, seq, diff, moved in want:
        assert got[stream, seq]["diff"] == pytest.approx(diff, abs=1e-3) and got[stream, seq].moved == moved


def test_merged_boxes(spark):
    frames = defaultdict(list)
    for r in V.boxes(spark, SF).where("frame_id % 5 = 0").collect():
        frames[r.frame_id].append(r)
    want = set()
    for frame, boxes in frames.items():
        root = {b.pos: b.pos for b in boxes}
        changed = True
        while changed:
            changed = False
            for a in boxes:
                for b in boxes:
                    over = min(a.y1, b.y1) - max(a.y0, b.y0) >= 0.55 * min(a.y1 - a.y0, b.y1 - b.y0)
                    near = max(a.x0, b.x0) - min(a.x1, b.x1) <= 0.55 * max(a.y1 - a.y0, b.y1 - b.y0)
                    if over and near and root[a.pos] != root[b.pos]:
                        root[a.pos] = root[b.pos] = min(root[a.pos], root[b.pos])
                        changed = True
        for k in set(root.values()):
            own = [b for b in boxes if root[b.pos] == k]
            want.add((frame, k, min(b.x0 for b in own), min(b.y0 for b in own), max(b.x1 for b in own), max(b.y1 for b in own), len(own)))
    assert {tuple(r) for r in sequences.merge_boxes(V.boxes(spark, SF).where("frame_id % 5 = 0")).collect()} == want


def test_frames_of_many_boxes_keep_apart(spark):
    rows = [(f, p, float(p * 100), 0.0, float(p * 100 + 5), 10.0) for f in (1, 2) for p in range(1500)]
    boxes = spark.createDataFrame(rows, "frame_id long, pos int, x0 double, y0 double, x1 double, y1 double")
    assert sequences.merge_boxes(boxes).count() == 3000


def test_exact_order_agrees_where_rows_are_plain(spark):
    exact = {r.frame_id: r.text for r in rows_of(spark, "w8_exact_order")}
    assert exact == {r.frame_id: r.text for r in rows_of(spark, "w8_reading_order")}


def test_window_merge(spark):
    canon = str.maketrans(T.CYRILLIC_LOOKALIKE, T.LATIN_LOOKALIKE)
    want = set()
    for stream, rows in by_stream(V.captures(spark, SF).collect(), order=("seq",)).items():
        merged = ""
        for r in rows:
            tail, head = (x.translate(canon).lower() for x in (merged[-48:], r.text[:48]))
            end, best = 0, 0
            for k in range(min(24, len(head))):
                n = max((n for n in range(4, len(head) - k + 1) if head[k : k + n] in tail), default=0)
                if n > best:
                    end, best = k + n, n
            merged += r.text[end:]
            want.add((stream, r.seq, r.text[end:]))
    assert {tuple(r) for r in rows_of(spark, "t23_window_merge")} == want


def test_dedup_buffer(spark, halves):
    want = set()
    for stream, rows in by_stream(halves).items():
        held = []
        for r in rows:
            key = " ".join(r.text.lower().split())
            if key not in held:
                held = (held + [key])[-20:]
                want.add((stream, r.seq, r.text))
    assert {tuple(r) for r in rows_of(spark, "x4_dedup_buffer")} == want


def test_min_gap(spark, halves):
    want = set()
    for stream, rows in by_stream(halves).items():
        free = None
        for r in rows:
            if free is None or r.t >= free:
                free = r.t + max(1000, 20 * len(r.text))
                want.add((stream, r.seq, r.t))
    assert {tuple(r) for r in rows_of(spark, "x14_min_gap")} == want


def test_text_changes(spark, halves):
    want = set()
    for stream, rows in by_stream(halves).items():
        seen, last = {}, ""
        for r in rows:
            key = re.sub(r"[.,!?:;\- ]+$", "", " ".join(r.text.lower().split()))
            if len(key) < 4:
                continue
            seen = {k: t for k, t in seen.items() if r.t - t <= 1000}
            same = next((k for k in seen if k in key or key in k), None)
            if key in seen:
                seen[key] = r.t
            elif last and alike(key, last) > 0.85:
                if len(key) > len(last):
                    last = key
                    seen[key] = r.t
            elif same is not None:
                seen[same] = r.t
            else:
                seen[key] = r.t
                last = key
                want.add((stream, r.seq, r.text))
    assert {tuple(r) for r in rows_of(spark, "x1_text_change")} == want


def test_no_word_is_lost_and_none_comes_twice(spark, halves):
    said = defaultdict(list)
    for r in sorted(rows_of(spark, "x3_chunker"), key=lambda r: r.seq):
        said[r.stream_id].append(r.text.split())
    for stream, rows in by_stream(halves).items():
        every = [w for r in rows for w in r.text.split()]
        assert sorted(w for c in said[stream] for w in c) == sorted(every)
        assert all(len(c) <= 16 for c in said[stream])


def test_idle_chunks(spark):
    rows = spark.createDataFrame([(1, 0, 0, "two words"), (1, 1, 9000, "one more, please."), (2, 0, 0, "lone"), (2, 1, 9000, "word"), (3, 0, 0, "a b c,")], "stream_id long, seq long, t long, text string")
    got = sorted(map(tuple, fold.table_fold(rows, "stream_id", ["t", "seq"], steps.Chunks()).collect()))
    assert got == [(1, 0, "two words"), (1, 1, "one more, please."), (2, 1, "lone word"), (3, 0, "a b c,")]


def test_cuts_cover_all_speech(spark):
    """Pieces follow each other, none is longer than the limit, and the first and last moments of a stream are in them."""
    found = spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'").collect()
    spans = defaultdict(list)
    for r in found:
        a = r.conv_id * 3600000 + r.turn * 4000
        spans[r.conv_id].append((a, a + 1000 + (len(r.text) % 30) * 100))
    pieces = defaultdict(list)
    for r in rows_of(spark, "x6_forced_cut"):
        pieces[r.stream_id].append((r.t0, r.t1))
    for stream, own in spans.items():
        cut = sorted(pieces[stream])
        assert cut[0][0] == min(own)[0] and cut[-1][1] == max(b for _, b in own)
        assert all(b - a <= 8000 for a, b in cut) and all(x[1] <= y[0] for x, y in zip(cut, cut[1:], strict=False))
        for a, b in own:
            assert sum(max(0, min(b, y) - max(a, x)) for x, y in cut) == b - a


@pytest.mark.parametrize("step", [steps.Cuts(), steps.WindowMerge(), steps.Admissions(), steps.MaturingLines()])
def test_more_folds_agree_on_streams_and_tables(spark, step, halves):
    from captext.plans.stream_queries import capture_stream, speech_stream

    spoken = isinstance(step, steps.Cuts)
    stream, order = (speech_stream(spark, SF), ["t0", "seq"]) if spoken else (capture_stream(spark, SF), ["t", "seq"])
    table = V.speech(spark, SF) if spoken else spark.createDataFrame([dict(r) for r in halves], "stream_id long, seq long, t long, text string")
    a = sorted(map(tuple, live.folded(stream, "stream_id", order, step).collect()))
    assert a == sorted(map(tuple, fold.table_fold(table, "stream_id", order, step).collect())) and a


def matured(spark, *frames):
    rows = spark.createDataFrame([(1, i, i * 500, t) for i, t in enumerate(frames)], "stream_id long, seq long, t long, text string")
    return [r.text for r in fold.table_fold(rows, "stream_id", ["t", "seq"], steps.MaturingLines()).orderBy("seq").collect()]


def test_lines_mature(spark):
    assert matured(spark, "the gate is open", "the gate is open") == ["the gate is open"]
    assert matured(spark, "flicker of noise", "another thing entirely") == []
    # A line that is typed out: its start once it is seen again, then only what is new.
    assert matured(spark, "the gate", "the gate is op", "the gate is open now my friend", "the gate is open now my friend") == ["the gate is op", "open now my friend"]
    # Two lines of one capture mature on their own, a known one is not said again.
    assert matured(spark, "first line here\nsecond one there", "first line here\nsomething else now", "second one there\nfirst line here") == ["first line here"]
    assert matured(spark, "We go n0w", "we go now!") == ["we go now!"]


def test_scanned_files(spark, tmp_path):
    for name in ("a.PNG", "b.png", "c.txt", "sub/d.Png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    names = lambda deep: sorted(os.path.relpath(r.path.removeprefix("file:"), tmp_path) for r in files.scan_files(spark, str(tmp_path), (".png",), deep).collect())
    assert names(True) == ["a.PNG", "b.png", "sub/d.Png"] and names(False) == ["a.PNG", "b.png"]
    got = {r.file: r.length for r in rows_of(spark, "s1_scan_files")}
    assert got == {n: os.path.getsize(f"{SF}/{n}") for n in os.listdir(SF) if n.lower().endswith((".parquet", ".pq"))}


def test_marks_inside_texts_stay(spark, tmp_path):
    """Texts that hold the lines which part records, and such lines with backslashes before them."""
    texts = ["plain", "a\n=== b ===\nc", "=== x ===", "\\=== y ===\n\\\\=== z", "a\n\n=== b ===\n\nc", f"a\n{files.RULE}\nb\n\\{files.RULE}", "", "\\ only"]
    rows = spark.createDataFrame([(f"f{i}.png", t, True, None, len(t), 1) for i, t in enumerate(texts)], "filename string, text string, success boolean, error string, chars long, lines long")
    files.write_results(rows, f"{tmp_path}/batch")
    for kind in ("txt", "json"):
        assert {r.filename: r.text for r in files.read_results(spark, f"{tmp_path}/batch", kind).collect()} == {f"f{i}.png": t for i, t in enumerate(texts)}
    log = rows.selectExpr("filename AS at", "cast(7 AS double) AS conf", "cast(0.5 AS double) AS scan_s", "text")
    files.write_capture_log(log, f"{tmp_path}/log")
    assert {r["at"]: r.text for r in files.read_capture_log(spark, f"{tmp_path}/log").collect()} == {f"f{i}.png": t for i, t in enumerate(texts)}


def test_pictures(spark):
    from captext.operators import pictures

    rng = np.random.default_rng(3)
    frame = rng.uniform(0, 255, (9, 12))
    row = spark.createDataFrame([(frame.ravel().tolist(),)], "luma array<double>")
    got = row.select(pictures.every_nth(F.col("luma"), 12, 4).alias("a"), pictures.block_means(F.col("luma"), 12, 9, 4, 3).alias("b"), pictures.block_means(F.col("luma"), 12, 9, 5, 4).alias("c"), pictures.signature(F.col("luma"), 12, 9).alias("d")).first()
    assert np.allclose(np.reshape(got.a, (3, 3)), frame[::4, ::4])
    assert np.allclose(np.reshape(got.b, (3, 4)), frame.reshape(3, 3, 4, 3).mean((1, 3)))
    cuts = lambda n, k: [(i * n // k, (i + 1) * n // k) for i in range(k)]
    assert np.allclose(np.reshape(got.c, (4, 5)), [[frame[a:b, c:d].mean() for c, d in cuts(12, 5)] for a, b in cuts(9, 4)])
    assert len(got.d) == 16 and all(isinstance(x, int) for x in got.d)
    flat, sharp = [100.0] * 1024, (rng.integers(0, 2, 1024) * 255.0).tolist()
    rows = spark.createDataFrame([(1, flat), (2, sharp), (3, flat[:64])], "seq long, luma array<double>")
    assert {r.seq: r.blurred for r in scoring.sharpness(rows, width=32, step=4).collect()} == {1: True, 2: False}
    small = np.array(sharp).reshape(32, 32)[::4, ::4]
    lap = [9 * small[y, x] - small[y - 1 : y + 2, x - 1 : x + 2].sum() for y in range(1, 7) for x in range(1, 7)]
    assert scoring.sharpness(rows, width=32, step=4).where("seq = 2").first().sharpness == pytest.approx(np.var(lap), rel=1e-6)


@pytest.mark.parametrize("most", [5, 1 << 20])
def test_quantiles_by_ranks(spark, most):
    from captext.operators.quantiles import quantiles

    rng = np.random.default_rng(5)
    values = {"a": rng.normal(0, 9, 101), "b": np.repeat([1.0, 2.0], 30), "c": np.array([7.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, own in values.items() for v in own] + [("a", None), ("d", None), (None, 1.0)], "k string, v double")
    shares = {"low": 0.01, "half": 0.5, "high": 0.953, "top": 1.0}
    got = {r.k: r for r in quantiles(rows, "k", "v", shares, most=most).collect()}
    assert set(got) == {"a", "b", "c"}
    for k, own in values.items():
        assert [got[k][n] for n in shares] == pytest.approx([np.quantile(own, p) for p in shares.values()])
    for r in quantiles(rows.where("k IS NOT NULL"), "k", "v", shares, error=0.01).collect():
        own = np.sort(values[r.k])
        for n, p in shares.items():
            assert own[max(0, int((p - 0.02) * len(own)) - 1)] <= r[n] <= own[min(len(own) - 1, int((p + 0.02) * len(own)) + 1)]


def test_fuzzy_words_of_all_lengths_and_letters(spark):
    rng = random.Random(12)
    letters = "abcdeäßéж"
    known = {"".join(rng.choices(letters, k=n)) for n in range(1, 30) for _ in range(12)}

    def edited(w):
        for _ in range(rng.randint(1, 3)):
            at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            w = w[:at] + (rng.choice(letters) if kind < 2 else "") + w[at + (kind > 0) :]
        return w

    asked = {edited(w) for w in known} - known - {""}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for most in (1, 2):
        words, table = spark.createDataFrame([(w,) for w in asked] + [(None,)], "word string"), spark.createDataFrame([(w, len(w) % 3 + 1) for w in known], "word string, freq long")
        got = {r.word: (r.dist, r.best) for r in lexicon.fuzzy_lexicon(words, table, most).collect()}
        want = {}
        for w in asked:
            near = [(d, -(len(k) % 3 + 1), k) for k in known if abs(len(k) - len(w)) <= most and (d := distance(w, k)) <= most]
            if near:
                d, _, k = min(near)
                want[w] = (d, k)
        assert got == want and len(want) > 100


def test_long_glued_words(spark):
    known = spark.createDataFrame([("on", 50), ("one", 50), ("two", 3), ("et", 3)], "word string, freq long")
    words = spark.createDataFrame([("onetwo" * 100,), ("onetwo" * 2000 + "x",)], "word string")
    assert [r.parts for r in lexicon.split_glued(words, known).collect()] == [" ".join(["one", "two"] * 100)]


def test_splits_of_glued_words(spark):
    rng = random.Random(4)
    known = {"".join(rng.choices("abc", k=rng.randrange(1, 6))): rng.choice((3, 50)) for _ in range(25)}
    words = {"".join(rng.choices("abc", k=rng.randrange(6, 12))) for _ in range(150)} - set(known)

    def splits(word):
        if not word:
            yield ()
        for n in range(1, len(word) + 1):
            if word[:n] in known:
                for rest in splits(word[n:]):
                    yield (word[:n], *rest)

    want = {}
    for w in words:
        cost = lambda p: (sum(1 + 2 * max(0, 3 - len(x)) - 2 * (known[x] >= 20) for x in p), len(p), tuple(-len(x) for x in p))
        best = min(splits(w), key=cost, default=())
        if len(best) > 1:
            want[w] = " ".join(best)
    got = lexicon.split_glued(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(list(known.items()), "word string, freq long"))
    assert {r.word: r.parts for r in got.collect()} == want and len(want) > 20


def test_spelling_keeps_case_and_marks(spark):
    known = spark.createDataFrame([("window", 50), ("garden", 40), ("report", 30)], "word string, freq long")
    docs = spark.createDataFrame([(1, "Windw, GARDIN! the repotr-x it's windoww."), (2, None), (3, "xyzq window")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lexicon.correct_spelling(docs, known).collect()}
    assert got == {1: "Window, GARDEN! the repotr-x it's window.", 2: None, 3: "xyzq window"}


def test_phrases_first(spark):
    pairs = "src string, dst string"
    phrases = spark.createDataFrame([("good day", "bonjour"), ("good day sir", "bonjour monsieur"), ("thank you very much", "merci bien"), ("go", "allez!")], pairs)
    words = spark.createDataFrame([("day", "jour"), ("house", "maison"), ("is", "est")], pairs)
    lines = spark.createDataFrame([(1, "Good day sir, the house is big"), (2, "thank you very much"), (3, "go"), (4, "good day good"), (5, "it's a day")], "id long, line string")
    got = {r.id: r.text for r in lexicon.translate_phrases(lines, phrases, words, ["id"], contractions={"it's": "it is"}).collect()}
    assert got == {1: "bonjour monsieur maison est big", 2: "merci bien", 3: "allez!", 4: "bonjour good", 5: "it est jour"}


def test_large_tables_meet_by_vocabulary(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    from captext.plans.join_queries import GLOSSARY

    table = spark.createDataFrame(list(GLOSSARY), "src string, dst string")
    literal = sorted(map(tuple, lexicon.translate_words(docs, table).collect()))
    monkeypatch.setattr(lexicon, "MOST_LITERALS", 3)
    assert sorted(map(tuple, lexicon.translate_words(docs, table).collect())) == literal


def test_clean_chain(spark):
    known = spark.createDataFrame([("the", 50), ("castle", 40), ("gate", 40), ("open", 30)], "word string, freq long")
    docs = spark.createDataFrame([(1, "thecastle  gаte is ореn 1.500 ~~§ thnt..."), (2, None), (3, "abcdefghijklmn"), (4, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in cleaning.clean_documents(docs, cleaning.clean_stages({"thnt": "tent"}), known).collect()}
    assert out[1].text == "the castle gate is open 1.5 tent…" and out[1].changed == ["space", "scripts", "words", "tokens", "fixes", "decimals"]
    assert (out[2].text, out[2].changed) == (None, []) and out[3].ramp and not out[1].ramp and out[4].text == ""
    caption = {r.doc_id: r.text for r in cleaning.clean_documents(spark.createDataFrame([(1, "thecas-\ntle opcn , now")], "doc_id long, text string"), cleaning.CAPTION, known).collect()}
    assert caption == {1: "the castle open , now"}


def test_scripts(spark):
    cases = {"Поискwindow": "Поиск window", "тeкст": "текст", "rероrt": "report", "окноreport": "окно report", "wіndow": "window", "привіт": "привит", "SOS": "SOS", "оa": "оa", "ох": "ох"}
    got = {r.x: r.y for r in spark.createDataFrame([(x,) for x in cases], "x string").select("x", T.repair_homoglyphs(F.col("x")).alias("y")).collect()}
    assert got == cases
    tied = spark.createDataFrame([("оa",)], "x string").select(T.repair_homoglyphs(F.col("x"), "ru"), T.repair_homoglyphs(F.col("x"), "en")).first()
    assert tuple(tied) == ("оа", "oa")


def test_chunks_by_hand(spark):
    def plain(text):
        parts = [p.strip() for p in re.split(r"(?<=[.!?…])\s+|\n+", text) if p.strip()]
        out, held = [], ""
        kind = lambda s: "question" if "?" in s else "exclamation" if "!" in s else "statement"
        for p in parts:
            if held and len(held) + len(p) > 200:
                out.append((held, kind(held)))
                held = ""
            held = f"{held} {p}".strip()
            if p[-1] in ".!?…":
                out.append((held, kind(p)))
                held = ""
        return out + ([(held, kind(held))] if held else [])

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.regexp_replace("text", r"[.] ", " \n").alias("text"))
    for r in docs.select("text", T.chunks(F.col("text")).alias("c")).collect():
        assert [tuple(c) for c in r.c] == plain(r.text)


def test_yin_finds_a_tone(spark):
    n = np.arange(64)
    rows = spark.createDataFrame([(k, [float(v) for v in np.sin(2 * np.pi * n / k)]) for k in (10, 16, 25)], "vec_id long, samples array<double>")
    # The first lag below the dip lies just before the period.
    assert all(0 <= r.vec_id - r.lag <= 2 for r in scoring.yin_lags(rows).collect())
    both = {r.vec_id: r for r in scoring.combined_pitch(rows, scoring.pitch_lags(rows, high=30), scoring.yin_lags(rows)).collect()}
    assert all(abs(r.pitch_hz - 16000 / k) < 0.15 * 16000 / k and r.conf > 0.5 for k, r in both.items())


def test_named_recognisers():
    files.register_recogniser("lower", lambda: str.lower)
    assert files.recogniser("lower")("AB") == "ab"
    with pytest.raises(KeyError, match="nothing"):
        files.recogniser("nothing")
