"""Queries over streams, folds, files and hooks, with DuckDB SQL where a batch twin has the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captext.functions import text as T
from captext.operators import fusion
from captext.operators.sequences import service_state
from captext.plans import views as V
from captext.plans.join_queries import J10, J11, J12, REGIONS, frame, values
from captext.plans.text_queries import SENTENCES
from captext.plans.window_queries import W13
from captext.session import scratch, small_batches
from captext.sources import files
from captext.sources.memory import Memory
from captext.streaming import fold, joins, live, steps


def capture_stream(s: SparkSession, d: str) -> DataFrame:
    rows = live.stream_table(s, d, "conversations").withColumn("copy", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))))
    return rows.selectExpr("conv_id AS stream_id", "turn * 3 + copy AS seq", "conv_id * 3600000 + (turn * 3 + copy) * 600 AS t", "CASE WHEN copy = 0 THEN substr(text, 1, length(text) div 2) ELSE text END AS text")


def folded(step, *more: str):
    return lambda s, d: live.folded(capture_stream(s, d).selectExpr("*", *more), "stream_id", ["t", "seq"], step)


at = live.at


def speech_stream(s, d):
    return live.stream_table(s, d, "conversations").where("role = 'user'").selectExpr("conv_id AS stream_id", "turn AS seq", "conv_id * 3600000 + turn * 4000 AS t0", "conv_id * 3600000 + turn * 4000 + 1000 + (length(text) % 30) * 100 AS t1", "text")


def subtitle_stream(s, d):
    rows = live.stream_table(s, d, "conversations").withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).where("CASE WHEN own THEN role = 'user' AND turn % 7 <> 0 ELSE role = 'assistant' END")
    return rows.selectExpr(
        "conv_id AS stream_id", "conv_id * 3600000 + turn * 4000 + CASE WHEN own THEN ((turn % 5) - 1) * 2500 ELSE 0 END AS t", "CASE WHEN own THEN regexp_replace(text, ' [^ ]*$', '') ELSE text END AS text", "CASE WHEN own THEN turn ELSE turn + 100000 END AS seq"
    )


def playback_stream(s, d):
    return live.stream_table(s, d, "conversations").where("role = 'assistant'").selectExpr("conv_id AS stream_id", "conv_id * 3600000 + turn * 4000 AS t0", "conv_id * 3600000 + turn * 4000 + 2000 AS t1")


def event_stream(s, d, ends):
    return ends.until(live.stream_table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts")


def x5(s, d):
    return live.finished(s, lambda ends: live.sessions(event_stream(s, d, ends), "user_id", "6 hours", least=0.3), "sessions").select("user_id", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), "n")


X5 = """WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM b)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, count(*) AS n FROM r GROUP BY user_id, run HAVING epoch(max(ts)) - epoch(min(ts)) >= 0.3"""


def x6(s, d):
    return live.folded(speech_stream(s, d), "stream_id", ["t0", "seq"], steps.Cuts())


def x7(s, d):
    return joins.fused(s, speech_stream(s, d), subtitle_stream(s, d)).select("stream_id", "seq", "fused", F.round("overlap", 6).alias("overlap"), "text")


def x8(s, d):
    return joins.silent(s, subtitle_stream(s, d), speech_stream(s, d)).select("stream_id", "t", "text", "seq")


def x9(s, d):
    return joins.unechoed(s, speech_stream(s, d), playback_stream(s, d)).select("stream_id", "seq", "t0", "t1")


def x10(s, d):
    rows = capture_stream(s, d).withColumn("at", at("t")).withColumn("key", T.normalise_key(F.col("text"))).withWatermark("at", "10 seconds")
    return live.finished(s, lambda ends: rows.dropDuplicatesWithinWatermark(["stream_id", "key"]).select("stream_id", "key"), "distinct")


X10 = "SELECT DISTINCT stream_id, key FROM (SELECT conv_id AS stream_id, {k} AS key FROM conversations UNION ALL SELECT conv_id, {h} FROM conversations)"


def x11(s, d):
    rows = capture_stream(s, d).withColumn("arrived", F.expr("t + (stream_id * 7 + seq * 13) % 6000"))
    return live.finished(s, lambda ends: live.fresh(rows, "t", "arrived", 3000).select("stream_id", "seq"), "fresh")


X11 = "WITH c AS (SELECT conv_id AS stream_id, turn * 3 + copy AS seq FROM conversations, (VALUES (CAST(0 AS BIGINT)), (1), (2)) v(copy)) SELECT stream_id, seq FROM c WHERE (stream_id * 7 + seq * 13) % 6000 <= 3000"


def x12(s, d):
    def quiet(ends):
        return event_stream(s, d, ends).groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))

    return live.finished(s, quiet, "flushed").select("user_id", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"))


X12 = """WITH b AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b)
  SELECT user_id, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM r GROUP BY user_id, run"""


def x13(s, d):
    def polled(ends):
        return event_stream(s, d, ends).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n"))

    return live.finished(s, polled, "polled").select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_id", "n")


X13 = "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY event_type, date_trunc('hour', ts)"


def _answers(missing: DataFrame) -> DataFrame:
    """A provider of three ranks: the first accepted answer to each key, NULL where none is."""
    ranked = missing.withColumn("rank", F.explode(F.array(*(F.lit(i).cast("long") for i in (1, 2, 3))))).withColumn("result", F.expr("CASE (length(key) * rank) % 4 WHEN 0 THEN NULL WHEN 1 THEN '[x failed]' WHEN 2 THEN key ELSE concat('>> ', key) END"))
    good = F.coalesce(F.col("result").startswith(">>"), F.lit(False))
    return ranked.groupBy("lang", "key").agg(F.min_by(F.when(good, F.col("result")), F.when(good, F.col("rank"))).alias("answer"))


def _requests(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.trim("text").alias("key")).where("key IS NOT NULL")


def x15(s, d):
    """The memory holds what a first job learned from every second document."""
    memory = Memory(s, scratch(s, "memory"), ["lang", "key"], "key string, lang string, answer string")
    memory.answer(_requests(V.table(s, d, "documents").where("doc_id % 2 = 0")), _answers, batch=-1)
    return memory.enrich(_requests(live.stream_table(s, d, "documents")), _answers).select("doc_id", "answer", "hit")


_ANSWER = "CASE WHEN length(key) % 4 = 3 OR length(key) * 2 % 4 = 3 OR length(key) * 3 % 4 = 3 THEN concat('>> ', key) END"
X15 = f"""WITH r AS (SELECT doc_id, coalesce(lang, '') AS lang, trim(text) AS key FROM documents WHERE text IS NOT NULL), a AS (SELECT *, {_ANSWER} AS answer FROM r), m AS (SELECT DISTINCT lang, key FROM a WHERE doc_id % 2 = 0 AND answer IS NOT NULL)
  SELECT doc_id, coalesce(answer, '') AS answer, m.key IS NOT NULL AS hit FROM a LEFT JOIN m ON m.lang = a.lang AND m.key = a.key"""


def j4_persisted(s, d):
    """Memory after two jobs of which the second ran twice."""
    memory = Memory(s, scratch(s, "memory"), ["lang", "key"], "key string, lang string, answer string")
    rows = _requests(V.table(s, d, "documents"))
    memory.answer(rows.where("doc_id % 3 = 0"), _answers, batch=0)
    for _ in range(2):
        memory.answer(rows, _answers, batch=1)
    return memory.table().select("lang", "key", "answer")


J4P = f"WITH r AS (SELECT DISTINCT coalesce(lang, '') AS lang, trim(text) AS key FROM documents WHERE text IS NOT NULL) SELECT lang, key, {_ANSWER} AS answer FROM r WHERE ({_ANSWER}) IS NOT NULL"


def x16(s, d):
    rows = live.stream_table(s, d, "events", most_files=16).select(F.col("event_type").alias("service"), "ts", F.col("event_id").alias("id"), service_state(F.col("value") / 100).alias("state"))
    return live.alerts(rows, "service", ["ts", "id"], "state").select("service", "id", "state", "before")


def x17(s, d):
    out = live.fan_out(live.stream_table(s, d, "conversations"), {"users": lambda b: b.where("role = 'user'").select("conv_id", "turn", F.lit("users").alias("sink")), "all": lambda b: b.select("conv_id", "turn", F.concat(F.lit("["), "role", F.lit("]")).alias("sink"))})
    return out["users"].unionByName(out["all"])


X17 = "SELECT conv_id, turn, 'users' AS sink FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, concat('[', role, ']') FROM conversations"


def s1(s, d):
    return files.scan_files(s, d, (".parquet", ".PQ")).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


def s3(s, d):
    """The results of a batch as CSV, JSON and text blocks, each read back."""
    small_batches(s)
    rows = files.batch_process(V.table(s, d, "documents"), str.strip, "doc_id", "text").withColumn("filename", F.concat(F.lit("doc "), F.col("key").cast("string"), F.lit(".png")))
    path = scratch(s, "batch")
    files.write_results(rows, path)
    found = [files.read_results(s, path, kind).select("filename", "text", F.lit(kind).alias("sink")) for kind in ("csv", "json", "txt")]
    return found[0].union(found[1]).union(found[2])


_TXT = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
S3 = " UNION ALL ".join(f"SELECT concat('doc ', doc_id, '.png') AS filename, {_TXT} AS text, '{kind}' AS sink FROM documents" for kind in ("csv", "json", "txt"))


def s5(s, d):
    """History written as a table for people and taken in again, with a new time and no image."""
    rows = V.table(s, d, "conversations").selectExpr("cast(conv_id * 3600 + turn AS double) AS timestamp", "text AS source_text", "role AS voice_preset", "'a.png' AS image_path")
    held, path = files.new_history(s), scratch(s, "csv")
    files.append_history(rows, held)
    files.export_history(files.load_history(s, held), path)
    return files.import_history(s, path, F.lit(5.0)).select("timestamp", "source_text", "voice_preset", "image_path")


def s6(s, d):
    rows = V.table(s, d, "documents").select(F.concat(F.lit("2024-01-01 #"), F.col("doc_id").cast("string")).alias("at"), F.expr("cast(doc_id % 100 AS double)").alias("conf"), F.expr("cast(doc_id % 30 AS double) / 10").alias("scan_s"), "text")
    path = scratch(s, "log")
    files.write_capture_log(rows, path)
    return files.read_capture_log(s, path)


S6 = "SELECT concat('2024-01-01 #', doc_id) AS at, CAST(doc_id % 100 AS DOUBLE) AS conf, round(CAST(doc_id % 30 AS DOUBLE) / 10, 1) AS scan_s, text FROM documents"


def s8(s, d):
    from captext.plans.join_queries import REGIONS as held

    path = scratch(s, "regions")
    rows = [(n, x, y, w, h, n == "side") for n, _, x, y, w, h in held]
    frame(s, rows, "name string, x double, y double, width double, height double, locked boolean").write.json(path)
    return fusion.boxes_in_regions(V.boxes(s, d), files.valid_regions(files.read_regions(s, path))).groupBy("name").agg(F.count("*").alias("n"))


S8 = f"WITH {V.ctes('boxes')} SELECT name, count(*) AS n FROM boxes JOIN {values(REGIONS, 'name, ord, x, y, w, h')} ON x0 >= x AND x1 <= x + w AND y0 >= y AND y1 <= y + h WHERE w > 30 AND h > 12 AND name <> 'side' GROUP BY name"


def p1(s, d):
    def recognise(html: str) -> str:
        if len(html) % 7 == 0:
            raise ValueError("unreadable")
        return html

    return files.batch_process(V.table(s, d, "pages"), recognise, "page_id", "html").select("key", "success", "error", "chars", "lines")


P1 = "SELECT page_id AS key, length(html) % 7 <> 0 AS success, CASE WHEN length(html) % 7 = 0 THEN 'ValueError' END AS error, CASE WHEN length(html) % 7 <> 0 THEN length(html) END AS chars, CASE WHEN length(html) % 7 <> 0 THEN len(string_split(html, chr(10))) END AS lines FROM pages"


def p2(s, d):
    rows = V.table(s, d, "documents").select("lang", F.trim("text").alias("key"))
    memory = rows.where("length(key) % 2 = 0").select("lang", "key").distinct().withColumn("hit", F.lower("key"))
    return fusion.remember(rows, memory, ["lang", "key"], lambda missing: missing.withColumn("hit", F.concat(F.lit("new "), "key")))


P2 = "WITH r AS (SELECT DISTINCT lang, trim(text) AS key FROM documents) SELECT lang, key, CASE WHEN length(key) % 2 = 0 THEN lower(key) ELSE concat('new ', key) END AS hit FROM r"


def p5(s, d):
    """A recogniser found by its name."""
    files.register_recogniser("upper", lambda: str.upper)
    return files.batch_process(V.table(s, d, "pages"), files.recogniser("upper"), "page_id", "url").select("key", "text", "success")


def p7(s, d):
    return V.table(s, d, "documents").select("doc_id", "text").lateralJoin(files.SplitSentences(F.col("text").outer())).select("doc_id", "pos", "sentence")


P7 = f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s AS sentence FROM (SELECT doc_id, unnest({SENTENCES}) AS s, generate_subscripts({SENTENCES}, 1) AS i FROM documents)"
KEY_SQL = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+', ' ', 'g'))"

QUERIES = {
    "w3_hysteresis": (lambda s, d: fold.table_fold(V.frames(s, d), "stream_id", ["seq"], steps.Movement()), None),
    "t23_window_merge": (lambda s, d: fold.table_fold(V.captures(s, d), "stream_id", ["seq"], steps.WindowMerge()), None),
    "x1_text_change": (folded(steps.TextChanges()), None),
    "x2_line_maturation": (folded(steps.MaturingLines()), None),
    "x3_chunker": (folded(steps.Chunks()), None),
    "x4_dedup_buffer": (folded(steps.NewTexts()), None),
    "x5_sessions": (x5, X5),
    "x6_forced_cut": (x6, None),
    "x7_fusion": (x7, J10),
    "x8_silent": (x8, J11),
    "x9_echo_block": (x9, J12),
    "x10_event_dedup": (x10, X10.format(k=KEY_SQL.format("text"), h=KEY_SQL.format("substr(text, 1, length(text) // 2)"))),
    "x11_freshness": (x11, X11),
    "x12_flush": (x12, X12),
    "x13_poll": (x13, X13),
    "x14_min_gap": (folded(steps.Admissions(), "length(text) * 20 AS busy"), None),
    "x15_enrichment": (x15, X15),
    "j4_persisted": (j4_persisted, J4P),
    "x16_alerts": (x16, W13),
    "x17_fan_out": (x17, X17),
    "s1_scan_files": (s1, None),
    "s3_batch_sinks": (s3, S3),
    "s5_history_csv": (s5, "SELECT CAST(5.0 AS DOUBLE) AS timestamp, text AS source_text, role AS voice_preset, '' AS image_path FROM conversations"),
    "s6_capture_log": (s6, S6),
    "s8_regions": (s8, S8),
    "p1_recogniser_hook": (p1, P1),
    "p2_provider_hook": (p2, P2),
    "p5_named_recogniser": (p5, "SELECT page_id AS key, upper(url) AS text, true AS success FROM pages"),
    "p7_sentence_udtf": (p7, P7),
}
