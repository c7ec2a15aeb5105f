"""Odd inputs and sizes that queries failed at."""

from __future__ import annotations

import math
import random
import re
import time

import numpy as np

from pyspark.sql import functions as F

from captext.functions import text as T
from captext.operators import lexicon
from captext.operators.lines import explode_tokens
from captext.plans import registry

QUERIES = registry.queries()


def embeddings(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def tone(period):
    return [math.sin(2 * math.pi * i / period) for i in range(64)]


def test_steadied_pitch_of_an_utterance_that_begins_silent(spark, tmp_path):
    d = embeddings(spark, tmp_path, [(0, [0.0] * 64, 1), (1, tone(16), 1), (2, tone(16), 1), (3, tone(10), 2)])
    found = {r.label: (r.pitch_hz, r.conf) for r in QUERIES["a14_steadied"](spark, d).collect()}
    assert found[1] == (1000.0, 0.6)
    assert found[2][0] > 0


def test_every_frame_has_a_sharpness(spark, tmp_path):
    d = embeddings(spark, tmp_path, [(i, tone(3 + i), 0) for i in range(5)])
    rows = QUERIES["f17_blur"](spark, d).collect()
    assert sorted(r.seq for r in rows) == list(range(5))
    # A pixel's Laplacian needs all eight neighbours: 36 inner pixels a frame.
    luma = [(round((x + 1) * 127.5, 3) - 127) * 0.3 for x in np.array(tone(3), np.float32).tolist()]
    lap = [9 * luma[y * 8 + x] - sum(luma[(y + a) * 8 + x + b] for a in (-1, 0, 1) for b in (-1, 0, 1)) for y in range(1, 7) for x in range(1, 7)]
    mean = sum(lap) / 36
    assert abs(next(r.sharpness for r in rows if r.seq == 0) - sum((v - mean) ** 2 for v in lap) / 36) < 0.01



def test_similar_and_contained_lines_of_many_lengths(spark):
    from captext.operators import fusion

    rng = random.Random(7)
    texts = set()
    for n in (1, 2, 5, 9, 16, 17, 33, 40, 64, 130, 300):
        for _ in range(6):
            t = "".join(rng.choice("ab c") for _ in range(n))
            texts |= {t, t + "x", "yy" + t, t[: n // 2] + "q" + t[n // 2 + 1 :], t[1:]} - {""}
    frame = spark.createDataFrame([(t,) for t in sorted(texts)], "line string")
    want = {(a, b) for a in texts for b in texts if a < b and fusion.common_run(a, b) >= 0.75 - 1e-9}
    assert {(r.a, r.b) for r in fusion.similar_texts(frame, "line", 0.75).collect()} == want
    within = {(a, b) for a in texts for b in texts if len(a) >= 4 and a != b and a in b}
    assert {tuple(r) for r in fusion.contained_texts(frame, "line", 4).collect()} == within


def test_keys_of_lines_are_made_together():
    """A second of CPU time for a million characters at most."""
    from captext.operators import fusion

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(2500)]
    start = time.process_time()
    found = sum(len(numbers) for numbers, _ in fusion._anchors(texts, 0.75))
    assert found >= 2500 and time.process_time() - start < 1.0


def test_scripts_and_ramps_of_whole_texts(spark):
    words = ["tехt", "оa", "hello", "приbет", "текстtext", "wordслово", "і", "кiт", "Ёлка1", "", "мiсто-city", "абвгдежзиклм", "abcdefghij", "abc.defghij", "aabcdefghijk", " а"]
    text = "  ".join(words) + "\n\t" + " ".join(words)
    one = {r.x: r.y for r in spark.createDataFrame([(w,) for w in {*words, *text.replace("\n\t", "  ").split("  ")}], "x string").select("x", T.repair_homoglyphs(F.col("x")).alias("y")).collect()}
    want = re.sub(r"[^ \t\n\x0b\f\r]+", lambda m: one[m[0]], text)
    rows = spark.createDataFrame([(text,), (None,)], "x string").select(T.repair_scripts(F.col("x"))).collect()
    assert [r[0] for r in rows] == [want, None]
    ramps = {r.x: r.y for r in spark.createDataFrame([(w,) for w in words] + [(None,)], "x string").select("x", T.has_ramp(F.col("x")).alias("y")).collect()}
    plain = {r.x: r.y for r in spark.createDataFrame([(w,) for w in words], "x string").select("x", T.is_ramp(F.col("x")).alias("y")).where("x NOT LIKE '%.%' AND x NOT LIKE '%-%'").collect()}
    assert ramps[None] is None and not ramps["abc.defghij"] and all(ramps[w] == y for w, y in plain.items()) and ramps["abcdefghij"]


def test_words_that_only_share_a_part_do_not_meet():
    from captext.operators import lexicon

    rng = random.Random(5)
    known, asked = (["the" + "".join(rng.choices("etaoinsr", k=6)) for _ in range(300)] for _ in range(2))
    index = [lexicon.index_keys(k, 2) for k in known]
    met = sum(bool(lexicon.lookup_keys(w, 2) & keys) for w in asked for keys in index)
    assert met < 0.1 * len(asked) * len(known)


def test_many_known_words_of_one_text(spark):
    from captext.operators import cleaning

    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(2000)]
    long = "q" * 1500
    text = " ".join(w.capitalize() for w in words) + f" {long.capitalize()} rest"
    answers = spark.createDataFrame([(w, f"{w[:2]} {w[2:]}") for w in words] + [(long, f"{long[:700]} {long[700:]}")], "word string, put string")
    got = {r.doc_id: r.text for r in cleaning.replace_words(spark.createDataFrame([(1, text), (2, None), (3, "rest")], "doc_id long, text string"), "text", answers).collect()}
    put = " ".join(f"{w[:2].capitalize()} {w[2:]}" for w in words) + f" Q{long[1:700]} {long[700:]} rest"
    assert got == {1: put, 2: None, 3: "rest"}


def test_brief_texts_of_common_letters_are_found_by_hash(spark, monkeypatch):
    """Texts of few letters, whose pieces stand in every other text: only true pairs are made, FEW texts at once."""
    from captext.operators import fusion

    rng = random.Random(11)
    longer = ["".join(rng.choice("ab ") for _ in range(rng.randint(33, 400))) for _ in range(200)]
    brief = sorted({"".join(rng.choice("ab ") for _ in range(rng.randint(8, 31))) for _ in range(900)} | {t[i : i + n] for t in longer for i, n in ((3, 9), (0, 8), (len(t) - 31, 31))})
    found = [(brief[a], longer[b]) for x, y in fusion._held_in(longer, fusion._sought(brief, 8)) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    want = {(a, b) for a in brief for b in longer if a in b}
    assert sorted(found) == sorted(want) and len(want) > 600
    monkeypatch.setattr(fusion, "FEW", 500)
    texts = {*brief, *longer, *("é" * n for n in (1, 8, 9, 40))}
    frame = spark.createDataFrame([(t,) for t in sorted(texts)], "line string")
    assert {tuple(r) for r in fusion.contained_texts(frame, "line", 8).collect()} == {(a, b) for a in texts if len(a) >= 8 for b in texts if a != b and a in b}


def test_boxes_of_a_frame_are_worked_on_in_one_task(spark, monkeypatch):
    """No join and no rounds of jobs: a frame's boxes meet once, by frame."""
    from captext.operators import components, sequences

    def rounds(*_):
        raise AssertionError("rounds of jobs for boxes of a frame")

    monkeypatch.setattr(components, "connected_components", rounds)
    rng = random.Random(5)
    rows = []
    for frame in range(30):
        for pos in range(rng.choice((1, 2, 25, 60))):
            x, y = rng.randint(0, 400), rng.randint(0, 300)
            rows.append((frame, pos, float(x), float(y), float(x + rng.randint(0, 60)), float(y + rng.randint(-3, 40))))
    rows += [(40, 0, None, 0.0, 5.0, 9.0), (40, 1, 3.0, None, 9.0, 9.0), (40, 2, 90.0, 200.0, 95.0, None), (40, 3, None, None, None, None)]
    boxes = spark.createDataFrame([(*r, f"t{r[1]}") for r in rows], "frame_id long, pos int, x0 double, y0 double, x1 double, y1 double, text string")
    want = set()
    for frame in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == frame]
        root = {r[1]: r[1] for r in own}
        for _ in own:
            for _, p, *a in own:
                for _, o, *b in own:
                    least = lambda *v: min((x for x in v if x is not None), default=None)
                    most = lambda *v: max((x for x in v if x is not None), default=None)
                    less = lambda u, v: None if u is None or v is None else u - v
                    tall = (less(a[3], a[1]), less(b[3], b[1]))
                    over, thin, gap, high = less(least(a[3], b[3]), most(a[1], b[1])), least(*tall), less(most(a[0], b[0]), least(a[2], b[2])), most(*tall)
                    if p < o and None not in (over, thin, gap, high) and over >= 0.55 * thin and gap <= 0.55 * high:
                        root[p] = root[o] = min(root[p], root[o])
        for k in set(root.values()):
            held = [r for r in own if root[r[1]] == k]
            side = lambda i, f: f((r[i] for r in held if r[i] is not None), default=None)
            want.add((frame, k, side(2, min), side(3, min), side(4, max), side(5, max), len(held)))
    assert {tuple(r) for r in sequences.merge_boxes(boxes).collect()} == want and len(want) < len(rows)
    for read in (sequences.reading_order, sequences.reading_order_exact):
        plan = read(boxes.where("frame_id < 40"))._jdf.queryExecution().toString()
        assert "Join" not in plan and "Window" not in plan


def test_spoken_rules_one_by_one(spark):
    """Patterns that are tried where they can match only give what they give one after the other, also side by side."""
    from captext.functions import spoken

    texts = ["Dr.Dr. Dr. Dr.Mr.Mr. etc.etc.", "dr. ahhhahhh ahhh ohhh,ohh hmm", "_Dr. éDr. \U0001d400Dr. 1Dr.", "5 km5 km 7kmh 3 - 4-5", "", " e.g.e.g.|i.e. #No.No.", "z.B.z.B. d.h. usw.usw.", None]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    plain, made = F.col("x"), spoken.spoken_form(F.col("x"), "en")
    for pattern, to in spoken.spoken_rules("en"):
        plain = F.regexp_replace(plain, pattern, to)
    for a, b in rows.select(F.trim(plain), made).collect():
        assert a == b
    # One text each, so that a rule's own text is not made anew for each rule.
    assert rows.select(made)._jdf.queryExecution().analyzed().toString().count("x#") < 10


def test_long_words_are_repaired_in_one_go(spark):
    """Words without a Cyrillic letter are gone through once, not once from each of their letters."""
    text = "a" * 60_000 + " hеllo"
    start = time.time()
    rows = spark.createDataFrame([(text,)] * 4, "x string").select(T.repair_scripts(F.col("x")).alias("y")).collect()
    assert {r.y for r in rows} == {text[:60_001] + "hello"} and time.time() - start < 12


def test_kept_script_is_made_once(spark):
    rows = spark.createDataFrame([("añb§§c",), ("§",), ("",), (None,)], "x string").select(T.keep_script(F.col("x"), "A-Za-z").alias("y"))
    assert [r.y for r in rows.collect()] == ["abc", "§", "", None]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_trees_are_taken_apart_once(spark, tmp_path, monkeypatch):
    from captext.sources import files

    spark.sql("SELECT 1L AS event_id, 7L AS user_id, 'click' AS event_type, '{\"k\": 3}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    asked, flatten = [], files.flatten_settings
    monkeypatch.setattr(files, "flatten_settings", lambda *a: asked.append(1) or flatten(*a))
    rows = QUERIES["t26_flatten"](spark, str(tmp_path))
    assert sorted((r.path, r.value) for r in rows.collect()) == [("copy.id", "7"), ("on", "true"), ("props.k", "3"), ("user.id", "7"), ("user.kind", "set")]
    assert len(asked) == 1 and "from_json" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_of_a_line_of_many_words(spark):
    """The answers of a line were put together by copying all before each word."""
    pairs = "src string, dst string"
    phrases, words = spark.createDataFrame([("of the", "du")], pairs), spark.createDataFrame([("in", "dans")], pairs)
    lines = spark.createDataFrame([(1, "of the in word a " * 20_000)], "id long, line string")
    begun = time.monotonic()
    got = lexicon.translate_phrases(lines, phrases, words, ["id"]).collect()
    assert got[0].text == " ".join(["du dans word"] * 20_000)
    assert time.monotonic() - begun < 30


def test_phrases_of_large_tables(spark, monkeypatch):
    pairs = "src string, dst string"
    phrases, words = spark.createDataFrame([("of the", "du"), ("go", "allez")], pairs), spark.createDataFrame([("in", "dans")], pairs)
    lines = spark.createDataFrame([(1, "of the in word a"), (2, "go"), (3, "..."), (4, "zzz")], "id long, line string")
    few = sorted(map(tuple, lexicon.translate_phrases(lines, phrases, words, ["id"]).collect()))
    assert few == [(1, "du dans word"), (2, "allez"), (4, "zzz")]
    monkeypatch.setattr(lexicon, "MOST_LITERALS", 0)
    assert sorted(map(tuple, lexicon.translate_phrases(lines, phrases, words, ["id"]).collect())) == few


def test_only_chosen_pieces_meet_the_lexicon(spark, monkeypatch):
    """All pieces of every word were dealt out, some 55 for ten letters."""
    rng, asked = random.Random(2), []
    known = spark.createDataFrame([(w, rng.choice((3, 50))) for w in sorted({"".join(rng.choices("abcd", k=rng.randrange(1, 7))) for _ in range(200)})], "word string, freq long")
    words = spark.createDataFrame([("".join(rng.choices("abcdé", k=rng.randrange(1, 30))),) for _ in range(500)], "word string")
    edges = lexicon._edges
    monkeypatch.setattr(lexicon, "_edges", lambda rest, *more: asked.append(rest.count()) or edges(rest, *more))
    ways = (lexicon.split_glued, lexicon.longest_match)
    found = [sorted(map(tuple, way(words, known).collect())) for way in ways]
    assert found[0] and len(found[1]) == words.distinct().count() and asked == [0, 0]
    # A sieve that passes everything: all words with an unknown piece go the exact way, with the same result.
    monkeypatch.setattr(lexicon, "_passed", lambda sieve, hashes, often: np.ones(len(hashes), bool))
    assert [sorted(map(tuple, way(words, known).collect())) for way in ways] == found and min(asked[2:]) > 50
    # An unknown word that passes by chance is no piece of itself.
    assert lexicon._cheapest("window", [(3, 3, False), (0, 6, True), (0, 3, False)]) == (["win", "dow"], [False, False])


def test_counts_of_classes(spark):
    """Spark's own count makes an array of all matches."""
    texts = ["", "aБ1 ^^[]\\ é😀-", "....", None, "x" * 50 + "\n"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    for p in (r"\p{L}", r"\p{Nd}", r"[^\p{L}\p{N}\s.,!?\-:;'\"()]", "[A-Za-z]", r"[|~`{}<>\[\]\\^_]", "[^^a]", r"[\p{L}\p{N}_]+", r"[\x{0400}-\x{04FF}]"):
        found = rows.select(T.n_matches(F.col("text"), p).alias("n"), F.regexp_count("text", F.lit(p)).alias("want")).collect()
        assert [r.n for r in found] == [r.want for r in found]
    assert "regexp_count" not in str(T.n_matches(F.col("text"), r"\p{L}"))


def test_phrases_without_dealing_out_tokens(spark):
    phrases = spark.createDataFrame([("of the", "du"), ("the of", "le de"), ("go", "allez")], "src string, dst string")
    docs = spark.createDataFrame([(1, "Of the of the\n of  the"), (2, None), (3, ""), (4, "go"), (5, " x of the go ")], "doc_id long, text string")
    tokens = explode_tokens(docs)
    found = lexicon.phrase_hits_in_texts(docs, phrases)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, lexicon.phrase_hits(tokens, phrases).collect())) != []
    assert "lead(" not in QUERIES["j2_phrases"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_script_runs_of_places_and_tokens(spark, tmp_path):
    """Each token went out twice, beside its place and its form with noise."""
    spark.createDataFrame([(1, "seven of  nine\ncome 12"), (2, None), (3, "a b"), (4, "word")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("web")}).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["t17_script_runs"](spark, str(tmp_path))
    assert [r.run for r in rows.where("doc_id = 1").orderBy("pos").collect()] == ["seven", "севен,", "nine", "нине,", "come", "цоме"]
    assert {r.doc_id for r in rows.collect()} == {1, 4}
    assert "raw" not in rows._jdf.queryExecution().analyzed().toString()


def test_batch_sinks_take_small_batches(spark):
    """A batch of 64 MB of texts stood several times in a Python worker."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        assert QUERIES["s3_batch_sinks"](spark, "/root/testdata/sf0.001").count() == 600
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_texts_are_cleaned_without_arrays_of_their_runs(spark):
    """A text's runs as an array take several times the text, in the JVM and on the way to Python."""
    from captext.operators import cleaning

    known = spark.createDataFrame([("the", 30), ("castle", 30), ("gate", 30)], "word string, freq long")
    docs = spark.createDataFrame([(1, "Thecastle \t§§ THNT ... a-\nb 1.500 thecastle"), (2, None), (3, ""), (4, "gate"), (5, "xthnt Thnt thnts-thnt")], "doc_id long, text string")
    made = cleaning.clean_documents(docs, cleaning.clean_stages({"thnt": "tent"}), known)
    assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: (r.text, r.changed) for r in made.collect()}
    assert got[1] == ("The castle TENT … ab 1.5 the castle", ["space", "hyphens", "words", "tokens", "fixes", "decimals"])
    assert got[2] == (None, []) and got[3] == ("", []) and got[4] == ("gate", [])
    assert got[5] == ("xthnt Tent thnts-tent", ["fixes"])


def test_plain_functions_of_texts(spark):
    texts = ["", " ", "\n", "a\t§ b\n\n ~~ \n--.. c\r x", "..\r ..\x85 § ", "\t.\t", "a1 1! §1", "я§ §§ 12"]
    good = [w for w in ("a", "b", "c\r", "x", "..\r", "..\x85", "--..", ".", "a1", "1!", "я§", "12")]
    got = {r.x: r.y for r in spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.keep_tokens(F.col("x")).alias("y")).collect()}
    assert got == {t: "\n".join(" ".join(w for w in line.replace("\t", " ").split(" ") if w in good) for line in t.split("\n")) for t in texts}
    held = {"σας": "a b", "tree": "t ree", "straße": "stra ße"}
    rows = spark.createDataFrame([("ΣΑΣ'Α Σας", held), ("Tree TREE trees tree-tree İtree tree", held), ("STRASSE Straße", held), ("tree", None)], "x string, k map<string, string>")
    assert [r.y for r in rows.select(T.put_known(F.col("x"), "L", "", F.col("k")).alias("y")).collect()] == ["A B'Α A b", "T ree T REE trees t ree-t ree İtree t ree", "STRASSE Stra ße", "tree"]
    many = {f"w{'abcdefghij'[i]}": str(i) for i in range(10)} | {"tree": "t ree"}
    assert T._put_runs("Tree wa,WB wcx", "L", "", many) == "T ree 0,1 wcx"
    broken = ["a-\nb-\nc-\nd", "a- \t\n\t b", "-\nb", "a-\n", "1-\na", "é-\nя", "a--\nb", "ab-\ncd-\nef"]
    rows = spark.createDataFrame([(t,) for t in broken], "x string").select(T.join_hyphens(F.col("x")).alias("a"), T.hyphens_joined(F.col("x")).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and rows[0].b == "ab-\ncd"
    found = spark.createDataFrame([("Tree tree's\nTREES x1 één-één", ), (None,)], "x string").select(T.distinct_words(F.col("x"), 3).alias("y")).collect()
    assert [sorted(r.y) for r in found] == [["tree", "trees", "één"], []]


def test_dirt_of_texts(spark, tmp_path):
    from captext.plans import text_queries as Q

    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("aeopcxyzt\n") for _ in range(rng.randint(0, 9))) for _ in range(n)) for n in (1, 5, 30, 400)] + ["", None]
    spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    both = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", F.expr(f"array_join(transform(split(text, ' '), (w, i) -> {Q.DIRT}), ' ')").alias("want")).join(Q.dirty(spark, str(tmp_path)), "doc_id").collect()
    assert len(both) == 6 and all(r.want == r.text for r in both)
    ramps = {"abcdefghij": True, "abcde,fghij": False, "x abcdefghi": False, "ab9abcdefghijk!": True, "": False}
    assert {t: r for t, r in ((r.x, r.y) for r in spark.createDataFrame([(t,) for t in ramps], "x string").select("x", T.has_ramp(F.col("x")).alias("y")).collect())} == ramps


def test_few_candidates_for_contained_texts_of_common_phrases():
    """Texts made of the same phrases share short substrings; what stands beside one tells most of them apart, and none that is contained is lost."""
    from collections import Counter

    from captext.operators import fusion

    rng = random.Random(5)
    phrases = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(10, 24))) for _ in range(60)]
    texts = {" ".join(rng.choice(phrases) for _ in range(rng.randint(2, 6))) for _ in range(2000)} | {"ab" * n for n in (16, 17, 40, 300)}
    texts = sorted(t for t in texts | {t[i : i + n] for t in list(texts)[:200] for i, n in ((0, 33), (5, 40), (11, 64))} if len(t) >= 32)
    own, holds = {}, {}
    for mine, found in ((True, own), (False, holds)):
        for numbers, c, keys in fusion._minimisers(texts, 32, mine):
            for i, k in zip(numbers.tolist(), keys.tolist(), strict=True):
                found.setdefault(i, set()).add((c, k))
    n = Counter(k for keys in holds.values() for k in keys)
    # By substrings alone there were some 14 candidates a text.
    assert sum(min(n[k] for k in own[i]) - 1 for i in own) < 3 * len(texts)
    within = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and a in b]
    assert len(within) > 300 and all(own[i] <= holds[j] for i, j in within)
    bits = fusion._key_bits(np.array([k for _, k in own[0]], np.int64), 1 << 15)
    sieve = np.zeros(1 << 12, np.uint8)
    for b in bits:
        np.bitwise_or.at(sieve, (b >> np.uint64(3)).astype(np.int64), np.left_shift(1, (b & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
    assert len(fusion._sieved(sieve, np.array([k for _, k in own[0]], np.int64))) == len(own[0])
    assert len(fusion._sieved(sieve, np.arange(1000))) < 10
