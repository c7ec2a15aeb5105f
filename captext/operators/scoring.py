"""Scores, classes and routes of texts, voices and frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captext.functions.text import n_matches, token_overlap
from captext.operators.pictures import every_nth
from captext.operators.quantiles import quantiles

#: Weights of an utterance's features, and the scores from which it is spoken or refined.
WEIGHTS = {
    "words": 1.0, "length": 1.0, "dialog_marks": 1.2, "sentence_start": 0.5, "screen_pos": 1.0, "stability": 1.6,
    "freshness": 0.8, "not_gibberish": 1.6, "has_voice": 2.0, "voice_text": 1.2, "overlap_voice": 1.5, "not_echo": 1.5,
}
SPEAK, REFINE = 0.55, 0.30


def utterance_features() -> dict[str, Column]:
    """Features from 0 to 1 of text, has_voice, voice_text, stability, screen_pos, age and is_echo."""
    t = F.trim(F.coalesce("text", F.lit("")))
    w = F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    n, letters, digits = F.size(w), n_matches(t, r"\p{L}"), n_matches(t, r"\p{Nd}")
    han = n_matches(t, r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]")
    count = n + F.floor(han / 2)
    scraps = F.size(F.filter(w, lambda x: F.length(x) <= 2))
    mixed = F.size(F.filter(w, lambda x: x.rlike(r"\p{Nd}")))
    plain = (count >= 2) & (letters >= 3) & (scraps <= n * 0.5) & (mixed == 0) & (digits <= F.greatest(F.lit(1), F.floor(letters / 4)))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return {
        "words": yes(count >= 1), "length": clamp(count / 6.0), "dialog_marks": yes(t.rlike("[.?!…]")), "sentence_start": yes(t.rlike(r"^\p{Lu}") | (han > 0)),
        "screen_pos": clamp(F.col("screen_pos")), "stability": clamp(F.col("stability") / 3.0), "freshness": clamp(1.0 - F.col("age") / 5.0), "not_gibberish": yes((han >= 2) | plain),
        "has_voice": yes(F.col("has_voice")), "voice_text": yes(n_matches(F.coalesce("voice_text", F.lit("")), r"[\p{L}\p{N}_]+") >= 2), "overlap_voice": token_overlap(F.col("voice_text"), F.col("text")), "not_echo": yes(~F.col("is_echo")),
    }


def decide_utterances(rows: DataFrame, weights: dict[str, float] = WEIGHTS, reasons: int = 4) -> DataFrame:
    """rows with score, action (speak, refine, skip), pros and cons; an echo or a blank text is always skipped with score 0.

    pros and cons name the first `reasons` features, in the order of the weights,
    that are at 0.5 or more (with what they add) and below (with what they cost).
    """
    used = {k: w for k, w in weights.items() if w > 0}
    parts = utterance_features()
    rows = rows.withColumns({f"_{k}": parts[k] for k in used})
    total = sum((F.col(f"_{k}") * w for k, w in used.items()), F.lit(0.0)) / sum(used.values())
    hard = F.col("is_echo") | (F.trim(F.coalesce("text", F.lit(""))) == "")
    told = lambda sign, when, much: F.array_join(F.slice(F.array_compact(F.array(*(F.when(when(F.col(f"_{k}")), F.format_string(f"{k}{sign}%.2f", F.floor(F.lit(w) * much(F.col(f"_{k}")) * 100 + 0.5) / 100)) for k, w in used.items()))), 1, reasons), " ")
    rows = rows.withColumns({
        "score": F.when(hard, 0.0).otherwise(total),
        "pros": F.when(hard, "").otherwise(told("+", lambda v: v >= 0.5, lambda v: v)),
        "cons": F.when(hard, "").otherwise(told("-", lambda v: v < 0.5, lambda v: 1.0 - v)),
    }).drop(*(f"_{k}" for k in used))
    return rows.withColumn("action", F.when(hard, "skip").when(F.col("score") >= SPEAK, "speak").when(F.col("score") >= REFINE, "refine").otherwise("skip"))


def keyword_emotion(rows: DataFrame, keywords: DataFrame, profanity: list[str], key: str = "doc_id") -> DataFrame:
    """key and emotion, the class whose stems occur most; keywords: emotion, ord, stem.

    Profanity adds 2 to angry, a question mark 1 to thinking and 0.5 to surprised,
    an exclamation mark 1 to the leader or 0.5 to surprised. Below 1 it is neutral;
    ties go by ord.
    """
    low = F.translate(F.lower(F.coalesce("text", F.lit(""))), "ё", "е")
    classes = [(r["emotion"], r["stems"]) for r in keywords.groupBy("emotion").agg(F.min("ord").alias("ord"), F.sort_array(F.collect_list("stem")).alias("stems")).orderBy("ord").collect()]
    hit = lambda stem: F.contains(F.col("_low"), F.lit(stem)).cast("double")
    rows = rows.withColumn("_low", low)
    question, shout = F.col("_low").contains("?"), F.col("_low").contains("!")
    scores: dict[str, Column] = {}
    for name, stems in classes:
        score = sum((hit(s) for s in stems), F.lit(0.0))
        if name == "angry" and profanity:
            score = score + F.when(F.col("_low").rlike("|".join(profanity)), 2.0).otherwise(0.0)
        if name == "thinking":
            score = score + F.when(question, 1.0).otherwise(0.0)
        if name == "surprised":
            score = score + F.when(question, 0.5).otherwise(0.0)
        scores[name] = score
    rows = rows.withColumns({f"_s_{k}": v for k, v in scores.items()})
    top = F.greatest(*(F.col(f"_s_{k}") for k in scores))
    leader = F.coalesce(*(F.when(F.col(f"_s_{k}") == top, F.lit(k)) for k in scores))
    rows = rows.withColumn("_top", top).withColumn("_lead", leader)
    best = F.col("_top") + F.when(shout & (F.col("_top") > 0), 1.0).otherwise(0.0)
    return rows.select(key, F.when(best >= 1, F.col("_lead")).otherwise("neutral").alias("emotion"))


def priority_emotion(text: Column, classes: list[tuple[str, list[str]]]) -> Column:
    """shout for two capitals in a row or a letter four times or more, else the first class with a stem, surprise for a question, else normal."""
    out = F.when(text.rlike(r"\p{Lu}{2,}") | F.lower(text).rlike(r"(\p{L})\1{3}"), "shout")
    for name, stems in classes:
        out = out.when(F.lower(text).rlike("|".join(stems)), name)
    return out.when(text.contains("?"), "surprise").otherwise("normal")


def situations(text: Column, patterns: list[tuple[str, str]], default: str = "narrator") -> Column:
    found = F.array_compact(F.array(*(F.when(F.lower(text).rlike(p), F.lit(name)) for name, p in patterns)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def preference_scores(corrections: DataFrame) -> DataFrame:
    """voice, situation, score: +1 for each new voice, -1 for an old one that had a score in the situation by then."""
    rows = corrections.select("seq", "situation", F.explode(F.array(F.struct(F.col("new_voice").alias("voice"), F.lit(1).alias("delta")), F.struct(F.col("old_voice").alias("voice"), F.lit(-1).alias("delta")))).alias("x")).select("seq", "situation", "x.voice", "x.delta")
    first = F.min(F.when(F.col("delta") == 1, F.col("seq"))).over(Window.partitionBy("situation", "voice"))
    rows = rows.withColumn("_first", first).where((F.col("delta") == 1) | (F.col("_first") < F.col("seq")))
    return rows.groupBy("voice", "situation").agg(F.sum("delta").alias("score"))


def best_voices(scores: DataFrame) -> DataFrame:
    """situation and voice, the one with the greatest score above -1, by name where they tie."""
    return scores.where("score > -1").groupBy("situation").agg(F.min_by("voice", F.struct(-F.col("score"), F.col("voice"))).alias("voice"), F.max("score").alias("score"))


def pick_voice(dialogue: DataFrame, scores: DataFrame, voices: DataFrame, narrator: str, prior: int = 10) -> DataFrame:
    """id and voice of dialogue (id, situations): the voice with the greatest sum of scores over the situations, by name where they tie.

    voices: voice and gender. A `dialogue_male` or `dialogue_female` among the
    situations admits that gender's voices only, all where it has none, and gives
    them `prior`; `narrator` gives it to that voice. voices is a small dimension.
    """
    wants = F.when(F.array_contains("situations", "dialogue_male"), "male").when(F.array_contains("situations", "dialogue_female"), "female")
    kinds = dialogue.select("situations").distinct().withColumn("_wants", wants)
    has = voices.groupBy("gender").agg(F.count("*").alias("_n")).withColumnRenamed("gender", "_g")
    kinds = kinds.join(has, F.col("_wants") == F.col("_g"), "left").withColumn("_wants", F.when(F.col("_n") > 0, F.col("_wants"))).drop("_g", "_n")
    learned = kinds.select("situations", F.explode("situations").alias("situation")).join(scores, "situation").groupBy("situations", "voice").agg(F.sum("score").alias("_s"))
    # Situation sets are few, so that each meets each voice that its gender admits.
    tried = kinds.join(voices, F.col("_wants").isNull() | (F.col("gender") == F.col("_wants"))).join(learned, ["situations", "voice"], "left")
    bonus = F.when(F.col("_wants") == F.col("gender"), prior).otherwise(0) + F.when(F.array_contains("situations", "narrator") & (F.col("voice") == narrator), prior).otherwise(0)
    best = tried.withColumn("_s", F.coalesce("_s", F.lit(0)) + bonus).groupBy("situations").agg(F.min_by("voice", F.struct(-F.col("_s"), F.col("voice"))).alias("voice"))
    return dialogue.join(best, "situations").select("id", "voice")


def prosody(emotion_rate: Column, emotion_pitch: Column, role_rate: Column, role_pitch: Column, kind: Column) -> tuple[Column, Column]:
    """(rate, pitch) of a sentence, within 100 and 50 either way; questions rise and slow, exclamations rise and speed up."""
    rate = role_rate + emotion_rate + F.when(kind == "question", -5).when(kind == "exclamation", 5).otherwise(0)
    pitch = role_pitch + emotion_pitch + F.when(kind == "question", 12).when(kind == "exclamation", 7).otherwise(0)
    return F.greatest(F.lit(-100), F.least(F.lit(100), rate)), F.greatest(F.lit(-50), F.least(F.lit(50), pitch))


def expand_prosody(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows (emotion, rate, pitch, factor) once a segment, with part, parts, rate and pitch: an archetype's factor scales both.

    A shout is a crescendo of three to six segments, as many as its first run of
    one letter is long: each has a base and its share of the emotion's values.
    """
    run = F.length(F.regexp_extract(F.lower(text), r"((\p{L})\2*)", 1))
    parts = F.when(F.col("emotion") == "shout", F.least(F.lit(6), F.greatest(F.lit(3), F.when(run > 0, run).otherwise(3)))).otherwise(1)
    rows = rows.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    share, shout = F.col("part") / F.col("parts"), F.col("emotion") == "shout"
    scaled = lambda base, c: ((F.when(shout, F.lit(base) + F.col(c) * share).otherwise(F.col(c))) * F.col("factor")).cast("int")
    return rows.withColumns({"rate": scaled(20, "rate"), "pitch": scaled(8, "pitch")})


#: The tests of a voice's gender and age in their order, with the label and how sure it is. p: pitch, c: centroid, b: bandwidth.
GENDERS = (
    ("p < 140 AND c > 2000", "male", "least(1.0, (140 - p) / 55 + 0.5) * 0.7"), ("p < 140", "male", "least(1.0, (140 - p) / 55 + 0.5)"), ("p < 180 AND c < 1800", "male", "0.55"), ("p < 180", "female", "0.55"),
    ("p < 280", "female", "least(1.0, (p - 165) / 80 + 0.4)"), ("true", "child", "least(1.0, (p - 270) / 100 + 0.4)"),
)
AGES = (
    ("p > 280", "child", "least(1.0, (p - 280) / 100 + 0.4)"), ("c < 1200 AND b < 500", "elderly", "0.6"), ("c > 1800 AND b > 600", "young", "0.6"), ("p > 160 AND p < 280 AND c > 1800", "young", "0.55"),
    ("p > 160 AND p < 280", "adult", "0.55"), ("p > 80 AND p <= 160 AND c > 1600", "young", "0.55"), ("p > 80 AND p <= 160", "adult", "0.55"), ("true", "adult", "0.5"),
)
STYLES = (("energy < -40 AND flatness > 0.2", "whisper"), ("energy > -10 AND p > 200", "shout"), ("p > 200 AND flatness > 0.12", "laugh"), ("p < 150 AND flatness < 0.03", "cry"))
#: Words of a voice's label.
GENDER_WORDS = {"male": "man", "female": "woman", "child": "child", "unknown": "?"}
STYLE_WORDS = {"shout": "(shouting)", "whisper": "(whispering)", "laugh": "(laughing)", "cry": "(crying)"}


def case_sql(rules: tuple, at: int, unsure: str, otherwise: str) -> str:
    """The rules as one CASE expression, for any SQL engine; item `at` of each is its answer."""
    return f"CASE WHEN {unsure} THEN {otherwise} " + " ".join(f"WHEN {r[0]} THEN {r[at]}" if at == 2 else f"WHEN {r[0]} THEN '{r[at]}'" for r in rules)


def voice_class(rows: DataFrame) -> DataFrame:
    """gender, age, style, sure (mean of the two labels' and the pitch's confidence) and label of pitch_hz, centroid, bandwidth, energy_db, flatness and conf."""
    names = {"p": "pitch_hz", "c": "centroid", "b": "bandwidth", "energy": "energy_db"}
    rows = rows.withColumns({k: F.col(v).cast("double") for k, v in names.items()})
    unsure = "conf < 0.3 OR p < 30"
    rows = rows.withColumns({
        "gender": F.expr(case_sql(GENDERS, 1, unsure, "'unknown'") + " END"), "age": F.expr(case_sql(AGES, 1, unsure, "'unknown'") + " END"), "style": F.expr(case_sql(STYLES, 1, "conf < 0.3", "'normal'") + " ELSE 'normal' END"),
        "sure": (F.expr(case_sql(GENDERS, 2, unsure, "0.0") + " END") + F.expr(case_sql(AGES, 2, unsure, "0.0") + " END") + F.col("conf")) / 3.0,
    })
    word = lambda c, known: F.coalesce(*(F.when(F.col(c) == k, F.lit(v)) for k, v in known.items()))
    who = F.concat_ws(", ", word("gender", GENDER_WORDS), F.when(~F.col("gender").isin("child", "unknown"), F.col("age")))
    return rows.withColumn("label", F.concat_ws(" ", who, word("style", STYLE_WORDS))).drop(*names)


def frame_class(rows: DataFrame, red: str = "r", green: str = "g", blue: str = "b", width: int = 8) -> DataFrame:
    """rows with mean, std (of the grey levels) and kind: clean, green, bright, dark or low_contrast.

    green: the frame's edge is greener than 100 and 1.2 times red and blue. clean:
    not green, a deviation above 40 and a mean between 40 and 220.
    """
    grey = F.transform(F.arrays_zip(F.col(red).alias("x"), F.col(green).alias("y"), F.col(blue).alias("z")), lambda v: (v["x"] + v["y"] + v["z"]) / 3)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)

    def edge(c: str) -> Column:
        n = F.size(c)
        rows_of = F.concat(F.slice(c, 1, width), F.slice(c, n - width + 1, F.lit(width)))
        sides = F.filter(c, lambda _, i: (i % width == 0) | (i % width == width - 1))
        both = F.concat(rows_of, sides)
        return total(both) / F.size(both)

    rows = rows.withColumns({"_grey": grey, "_r": edge(red), "_g": edge(green), "_b": edge(blue)})
    rows = rows.withColumn("mean", total(F.col("_grey")) / F.size("_grey"))
    rows = rows.withColumn("std", F.sqrt(total(F.transform("_grey", lambda v: (v - F.col("mean")) * (v - F.col("mean")))) / F.size("_grey")))
    is_green = (F.col("_g") > 100) & (F.col("_g") > F.col("_r") * 1.2) & (F.col("_g") > F.col("_b") * 1.2)
    clean = ~is_green & (F.col("std") > 40) & (F.col("mean") > 40) & (F.col("mean") < 220)
    kind = F.when(clean, "clean").when(is_green, "green").when(F.col("mean") >= 220, "bright").when(F.col("mean") <= 40, "dark").otherwise("low_contrast")
    return rows.withColumn("kind", kind).drop("_grey", "_r", "_g", "_b")


def sharpness(frames: DataFrame, key: str = "seq", luma: str = "luma", width: int = 8, least: float = 500.0, step: int = 1) -> DataFrame:
    """key, sharpness (variance of the eight-neighbour Laplacian over the inner pixels) and blurred (below `least`).

    With a `step` every so many pixels count, both ways (4: a quarter of the size).
    Pictures of less than three rows or columns are left out.
    """
    if step > 1:
        frames, width = frames.withColumn(luma, every_nth(F.col(luma), width, step)), (width - 1) // step + 1
    if width < 3:
        return frames.limit(0).select(key, F.lit(0.0).alias("sharpness"), F.lit(False).alias("blurred"))
    frames = frames.where(F.size(luma) >= 3 * width)
    at = lambda dx, dy: F.col(luma)[F.col("_y") * width + dy * width + F.col("_x") + dx]
    ring = sum((at(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy), F.lit(0.0))
    inner = frames.withColumn("_x", F.explode(F.sequence(F.lit(1), F.lit(width - 2)))).withColumn("_y", F.explode(F.sequence(F.lit(1), F.floor(F.size(luma) / width).cast("int") - 2)))
    return inner.groupBy(key).agg(F.round(F.var_pop(8 * at(0, 0) - ring), 3).alias("sharpness")).withColumn("blurred", F.col("sharpness") < least)


def stretch(rows: DataFrame, key: str, value: str, low: float = 0.01, high: float = 0.99, least: float = 10.0, error: float | None = None) -> DataFrame:
    """rows with `value` stretched from its quantiles by key to 0 to 255, as it is where they are less than `least` apart. See quantiles() for `error`."""
    cuts = quantiles(rows, key, value, {"_lo": low, "_hi": high}, error)
    put = F.when(F.col("_hi") - F.col("_lo") < least, F.col(value)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255)))
    return rows.join(cuts, key).withColumn(value, put).drop("_lo", "_hi")


def provider_health(answers: DataFrame, ok: Column, error: float | None = None) -> DataFrame:
    """provider, n, n_ok, mean_ms and p95_ms of answers (provider, lang, latency_ms), and langs: those in which it succeeded."""
    counts = answers.groupBy("provider").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.avg("latency_ms").alias("mean_ms"), F.array_join(F.sort_array(F.collect_set(F.when(ok, F.col("lang")))), ",").alias("langs"))
    return counts.join(quantiles(answers, "provider", "latency_ms", {"p95_ms": 0.95}, error), "provider", "left")


def frame_energy(samples: str = "samples") -> dict[str, Column]:
    """rms, peak and level in decibels (-60 at least) of an array of samples."""
    x = F.transform(samples, lambda v: v.cast("double"))
    rms = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x))
    return {"rms": rms, "peak": F.array_max(F.transform(x, F.abs)), "db": F.greatest(F.lit(-60.0), 20 * F.log10(F.greatest(rms, F.lit(1e-6))))}


def spectrum(rows: DataFrame, key: str = "vec_id", samples: str = "samples", size: int = 64, rate: int = 16000) -> DataFrame:
    """key, centroid, bandwidth, rolloff (85 %) and flatness (geometric over arithmetic mean) of Hann-windowed frames of `size` samples.

    Samples meet a fixed table of size * (size / 2 + 1) cosines and sines; sums by
    key and bin are partial before the shuffle.
    """
    spark = rows.sparkSession
    basis = spark.range(size * (size // 2 + 1)).selectExpr(f"cast(id div {size} AS int) AS k", f"cast(id % {size} AS int) AS n")
    angle = f"2 * pi() * k * n / {size}"
    basis = basis.selectExpr("k", "n", f"cos({angle}) * (0.5 - 0.5 * cos(2 * pi() * n / {size - 1})) AS c", f"sin({angle}) * (0.5 - 0.5 * cos(2 * pi() * n / {size - 1})) AS s")
    long = rows.select(key, F.posexplode(samples).alias("n", "x"))
    bins = long.join(F.broadcast(basis), "n").groupBy(key, "k").agg(F.sum(F.col("x").cast("double") * F.col("c")).alias("re"), F.sum(F.col("x").cast("double") * F.col("s")).alias("im"))
    power = bins.select(key, (F.col("k") * rate / size).alias("hz"), F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("m"))
    w = Window.partitionBy(key).orderBy("hz")
    power = power.withColumn("upto", F.sum("m").over(w)).withColumn("all", F.sum("m").over(Window.partitionBy(key)))
    out = power.groupBy(key).agg((F.sum(F.col("hz") * F.col("m")) / F.sum("m")).alias("centroid"), (F.sum(F.col("hz") * F.col("hz") * F.col("m")) / F.sum("m")).alias("second"), F.min(F.when(F.col("upto") >= 0.85 * F.col("all"), F.col("hz"))).alias("rolloff"), F.least(F.lit(1.0), F.exp(F.avg(F.log(F.col("m") + 1e-10))) / (F.avg("m") + 1e-10)).alias("flatness"))
    return out.select(key, "centroid", F.sqrt(F.greatest(F.col("second") - F.col("centroid") ** 2, F.lit(0.0))).alias("bandwidth"), "rolloff", "flatness")


def pitch_lags(rows: DataFrame, key: str = "vec_id", samples: str = "samples", low: int = 8, high: int = 32, least: float = 0.3) -> DataFrame:
    """key, lag and r: the lag of the greatest normalised autocorrelation, where it is `least` or more."""
    x = rows.select(key, F.transform(samples, lambda v: v.cast("double")).alias("x")).withColumn("e", F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).where("e > 0")
    lagged = x.withColumn("lag", F.explode(F.sequence(F.lit(low), F.lit(high))))
    product = F.zip_with(F.slice("x", F.lit(1), F.size("x") - F.col("lag")), F.slice("x", F.col("lag") + 1, F.size("x") - F.col("lag")), lambda a, b: a * b)
    scored = lagged.withColumn("r", F.round(F.aggregate(product, F.lit(0.0), lambda s, v: s + v) / F.col("e"), 9))
    return scored.groupBy(key).agg(F.max_by("lag", F.struct("r", -F.col("lag"))).alias("lag"), F.max("r").alias("r")).where(F.col("r") >= least)


def otsu(rows: DataFrame, key: str, value: str, low: float, high: float, bins: int = 64) -> DataFrame:
    """key and threshold: the first bin border with the greatest variance between what is below and above."""
    bucket = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / (high - low) * bins)).cast("int")
    hist = rows.groupBy(key, bucket.alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("b")
    whole = Window.partitionBy(key)
    hist = hist.withColumns({"wb": F.sum("n").over(w), "sb": F.sum(F.col("n") * F.col("b")).over(w), "w": F.sum("n").over(whole), "s": F.sum(F.col("n") * F.col("b")).over(whole)})
    between = F.col("wb") * (F.col("w") - F.col("wb")) * (F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / (F.col("w") - F.col("wb"))) ** 2
    return hist.where("w > wb").withColumn("v", F.round(between, 3)).groupBy(key).agg(F.min_by("b", F.struct(-F.col("v"), F.col("b"))).alias("threshold"))


def yin_lags(rows: DataFrame, key: str = "vec_id", samples: str = "samples", low: int = 8, high: int = 32, dip: float = 0.2, most: float = 0.5) -> DataFrame:
    """key, lag and conf: the first lag whose normalised difference falls below `dip`, else the least one if it is not above `most`.

    The difference of a lag sums (x[i] - x[i + lag])^2 over the first half of the
    frame, mean taken out; it is divided by the mean of those of all lags so far.
    conf is 1 less the value. Frames of one length are worked on together.
    """

    def run(batches):
        for frame in batches:
            for width, own in frame.groupby(frame[samples].map(len)):
                if width < 2 * (low + 1):
                    continue
                x = np.stack(own[samples].to_numpy()).astype(float)
                x -= x.mean(1, keepdims=True)
                half, last = width // 2, min(high, width - width // 2)
                d = np.stack([((x[:, :half] - x[:, t : t + half]) ** 2).sum(1) for t in range(1, last + 1)], 1)
                mean = np.cumsum(d, 1) / np.arange(1, last + 1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    value = np.round(d / mean, 9)[:, low - 1 :]
                below = value < dip
                at = np.where(below.any(1), below.argmax(1), np.argmin(value, 1))
                best = value[np.arange(len(value)), at]
                good = (d.sum(1) > 0) & (below.any(1) | (best <= most))
                yield pd.DataFrame({key: own[key].to_numpy()[good], "lag": (at + low)[good].astype(np.int32), "conf": np.maximum(0.0, 1.0 - best)[good]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.where(F.col(samples).isNotNull()).select(key, samples).mapInPandas(run, f"{key} {kind}, lag int, conf double")


def combined_pitch(keys: DataFrame, correlated: DataFrame, yin: DataFrame, key: str = "vec_id", rate: int = 16000) -> DataFrame:
    """key, pitch_hz and conf of both methods: their mean if they agree within 1.3, the lower one if not, the only one if one found none, 0 if none did."""
    a = correlated.select(key, (rate / F.col("lag")).alias("_a"), F.col("r").alias("_ca"))
    b = yin.select(key, (rate / F.col("lag")).alias("_b"), F.col("conf").alias("_cb"))
    out = keys.select(key).join(a, key, "left").join(b, key, "left")
    both, agree = F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.greatest("_a", "_b") / F.least("_a", "_b") < 1.3
    pitch = F.when(both & agree, (F.col("_a") + F.col("_b")) / 2).when(both, F.least("_a", "_b")).otherwise(F.coalesce("_b", "_a", F.lit(0.0)))
    sure = F.greatest("_ca", "_cb")
    conf = F.when(both & agree, sure * 1.1).when(both, sure * 0.8).otherwise(F.coalesce("_cb", "_ca", F.lit(0.0)))
    return out.select(key, pitch.alias("pitch_hz"), F.least(F.lit(1.0), conf).alias("conf"))


def steadied_pitch(pitches: DataFrame, windows: DataFrame, key: str, rate: int = 16000, least: float = 0.5) -> DataFrame:
    """pitches (key, pitch_hz, conf) where an unsure one (below `least`) gives way to the median of its windows (key, lag, r with r above 0.5).

    A median within a fifth of it only makes it surer, by 0.2; another one takes its place with 0.6.
    """
    median = windows.where("r > 0.5").groupBy(key).agg(F.percentile(rate / F.col("lag"), 0.5).alias("_m"))
    out = pitches.join(median, key, "left")
    ask = (F.col("conf") < least) & F.col("_m").isNotNull()
    # No pitch is 0 Hz: the quotient may be worked out before the test beside it.
    near = F.coalesce(F.abs(F.col("_m") - F.col("pitch_hz")) / F.nullif("pitch_hz", F.lit(0.0)) < 0.2, F.lit(False))
    return out.select(key, F.when(ask & ~near, F.col("_m")).otherwise(F.col("pitch_hz")).alias("pitch_hz"), F.when(ask & near, F.least(F.lit(1.0), F.col("conf") + 0.2)).when(ask, 0.6).otherwise(F.col("conf")).alias("conf"))


def candidate_quality(text: Column, letters: str, conf: Column, verified: Column) -> Column:
    """Share of a script's letters, up to 0.12 for the length, 0.2 if a verifier agrees, and the confidence; NULL for a blank text."""
    from captext.functions.text import script_share

    return F.when(F.trim(text) != "", script_share(text, letters) + F.least(F.length(text) * 0.01, F.lit(0.12)) + F.when(verified, 0.2).otherwise(0.0) + conf)


def covered_confidence(conf: Column, coverage: Column, least: float = 0.5) -> Column:
    """conf less up to 0.4 of it as the share of a frame that its box covers grows from `least` to all."""
    over = F.least(F.lit(1.0), (coverage - least) / (1.0 - least))
    return F.when(coverage <= least, conf).otherwise(conf * (1.0 - 0.40 * over))


def accepts(text: Column, conf: Column) -> Column:
    """A text of one to three letters needs a confidence of 0.12, others one of 0.25."""
    return conf >= F.when(n_matches(text, r"\p{L}").between(1, 3), 0.12).otherwise(0.25)


def confidence_gates(boxes: DataFrame, key: str, conf: str, box: float = 40.0, scan: float = 30.0) -> DataFrame:
    """key, n and mean of the boxes that are sure enough, for those keys whose mean is."""
    return boxes.where(F.col(conf) >= box).groupBy(key).agg(F.avg(conf).alias("mean"), F.count("*").alias("n")).where(F.col("mean") >= scan).select(key, "n", "mean")
