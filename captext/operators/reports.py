"""Picks, routes and reports over captures, speech, answers and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captext.functions import text as T


def joined_texts(order: str, text: str, between: str) -> Column:
    """Aggregate: a group's texts in their order, joined; a group is what one screen or stream holds."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), between)


def batch_summary(rows: DataFrame) -> DataFrame:
    """One row: total, ok, failed, chars and lines of batch results (success, chars, lines)."""
    return rows.agg(F.count("*").alias("total"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.sum("chars").alias("chars"), F.sum("lines").alias("lines"))


def best_pass(rows: DataFrame, key: str = "stream_id") -> DataFrame:
    """Of each key the recognition pass (rows: key, pass, seq, text, conf) of the highest mean confidence, the first of several: key, pass, text."""
    passes = rows.groupBy(key, "pass").agg(F.avg("conf").alias("conf"), joined_texts("seq", "text", " ").alias("text"))
    best = F.max_by(F.struct("pass", "text"), F.struct(F.round("conf", 9), -F.col("pass"))).alias("_x")
    return passes.groupBy(key).agg(best).select(key, "_x.*")


def region_texts(rows: DataFrame, key: str = "stream_id") -> DataFrame:
    """key and text: the latest text (by t) of each region, one to a line behind its name in brackets."""
    last = rows.groupBy(key, "region").agg(F.max_by("text", "t").alias("_t"))
    last = last.withColumn("text", F.concat(F.lit("["), F.col("region").cast("string"), F.lit("] "), F.col("_t")))
    return last.groupBy(key).agg(joined_texts("region", "text", "\n").alias("text"))


def speech_verdict(target: str, shortest: int = 2, no_speech: float = 0.6, logprob: float = -1.0, compression: float = 2.4) -> Column:
    """Why a segment (text, no_speech, logprob, compression, lang) is dropped, `kept` where it isn't; speech in the target language needs no translation."""
    return (
        F.when(F.length("text") < shortest, "short").when(F.col("no_speech") > no_speech, "no_speech").when(F.col("logprob") < logprob, "logprob")
        .when(F.col("compression") > compression, "compression").when(F.col("lang") == target, "target").otherwise("kept")
    )


def language_routes(texts: DataFrame, routes: DataFrame, other: str = "voice_any", text: str = "text") -> DataFrame:
    """texts with lang, by rules, and the voice that routes (lang, voice) have for it, else `other`."""
    found = texts.withColumn("lang", T.detect_language(F.col(text)))
    return found.join(routes.select("lang", "voice"), "lang", "left").withColumn("voice", F.coalesce("voice", F.lit(other)))


def uncovered(lexicon: DataFrame, known: DataFrame) -> DataFrame:
    """The words of a lexicon that `known` (src) has no answer to."""
    return lexicon.join(known.select(F.col("src").alias("word")), "word", "left_anti")


def last_voice(subtitles: DataFrame, speech: DataFrame, within: int = 1200) -> DataFrame:
    """Subtitles (stream_id, t, seq) with age, the ms since their stream last spoke, and voiced: at most `within`."""
    both = subtitles.select("stream_id", "t", "seq", F.lit(None).cast("long").alias("heard")).unionByName(speech.select("stream_id", F.col("t1").alias("t"), "seq", F.col("t1").alias("heard")))
    w = Window.partitionBy("stream_id").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    age = F.col("t") - F.max("heard").over(w)
    return both.withColumn("age", age).where("heard IS NULL").select("stream_id", "seq", F.coalesce(F.col("age") <= within, F.lit(False)).alias("voiced"), "age")


def best_block(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each key its best utterance among lines (key, line_no, line): an end mark counts 2, words up to eight count an eighth each; key, line, rank."""
    rows = lines.where(T.is_utterance(F.col("line"), 2))
    words = F.size(F.filter(F.split("line", " "), lambda x: x != ""))
    rank = F.when(F.col("line").rlike("[.?!…]"), 2.0).otherwise(0.0) + F.least(F.lit(1.0), words / 8.0)
    return rows.withColumn("rank", rank).groupBy(key).agg(F.max_by("line", F.struct("rank", -F.col("line_no"))).alias("line"), F.max("rank").alias("rank"))


def first_accepted(answers: DataFrame, key: str, accepted: Column, failure: str = "[failed]") -> DataFrame:
    """Of each key the accepted answer (rows: key, rank, result) of the least rank: key, rank, result, which is `failure` where none is."""
    good = F.coalesce(accepted, F.lit(False))
    first = answers.groupBy(key).agg(F.min_by(F.when(good, F.col("result")), F.when(good, F.col("rank"))).alias("result"), F.min(F.when(good, F.col("rank"))).alias("rank"))
    return first.select(key, "rank", F.coalesce("result", F.lit(failure)).alias("result"))


def worst_lines(lines: DataFrame, key: str = "doc_id", most: int = 6) -> DataFrame:
    """Of each key the `most` invalid lines with the most letters: key, line_no, letters."""
    rows = lines.where(~T.is_valid_text(F.col("line"))).withColumn("letters", T.n_matches(F.col("line"), r"\p{L}").cast("long"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("letters"), "line_no"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= most).select(key, "line_no", "letters")


def distinct_keys(rows: DataFrame, text: str, longer_than: int = 3) -> DataFrame:
    """key: the distinct normalised texts longer than `longer_than`."""
    return rows.select(T.normalise_key(F.col(text)).alias("key")).where(F.length("key") > longer_than).distinct()


def new_keys(rows: DataFrame, known: DataFrame, text: str = "text", by: str = "stream_id") -> DataFrame:
    """by and key: the distinct normalised texts of rows that `known` doesn't have under the same `by`."""
    keys = lambda t: t.select(by, T.normalise_key(F.col(text)).alias("key"))
    return keys(rows).distinct().join(keys(known), [by, "key"], "left_anti")
