"""Queries over ordered rows, top-k and retention, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captext.functions import text as T
from captext.operators import reports, scoring
from captext.operators import sequences as Q
from captext.operators.lines import explode_lines
from captext.operators.pictures import reused_results
from captext.plans import views as V
from captext.plans.join_queries import OVERLAP
from captext.plans.text_queries import KEY, LINES, has

W = "OVER (PARTITION BY stream_id ORDER BY seq)"
CAP = V.ctes("captures")


def events(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "events")


def w1(s, d):
    return Q.text_changes(V.captures(s, d)).select("stream_id", "seq", "changed", F.length("last_text").cast("long").alias("n_last"))


W1 = f"""WITH {CAP}, k AS (SELECT *, {KEY('text')} AS key FROM captures), c AS (SELECT *, coalesce(lag(key) {W} <> key, true) AS changed FROM k)
  SELECT stream_id, seq, changed, length(last_value(CASE WHEN changed THEN text END IGNORE NULLS) {W}) AS n_last FROM c"""


#: Each frame three times: as it is, with noise that a small copy doesn't show, and brighter by its number.
SHOWN = "transform(luma, x -> x + CASE copy WHEN 1 THEN 0.0001 WHEN 2 THEN seq % 3 ELSE 0 END)"


def w1_frames(s, d):
    rows = V.frames(s, d).withColumn("copy", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3))))).selectExpr("stream_id", "seq * 3 + copy AS seq", f"{SHOWN} AS luma", "concat('read ', seq * 3 + copy) AS text")
    return reused_results(rows, 8, 8).select("stream_id", "seq", "changed", "text")


_BLOCK = " + ".join(f"luma[(b // 4) * 16 + (b % 4) * 2 + {i}]" for i in (1, 2, 9, 10))
W1F = f"""WITH {V.ctes('frames')}, f AS (SELECT stream_id, seq * 3 + copy AS seq, {SHOWN.replace('transform(luma, x -> ', 'list_transform(luma, lambda x: ')} AS luma FROM frames, (VALUES (CAST(0 AS BIGINT)), (1), (2)) c(copy)),
  g AS (SELECT stream_id, seq, list_transform(range(0, 16), lambda b: CAST(floor(({_BLOCK}) / 4) AS INTEGER)) AS sig FROM f), c AS (SELECT *, coalesce(lag(sig) {W} <> sig, true) AS changed FROM g)
  SELECT stream_id, seq, changed, last_value(CASE WHEN changed THEN concat('read ', seq) END IGNORE NULLS) {W} AS text FROM c"""


def w2(s, d):
    return Q.frame_difference(V.frames(s, d)).select("stream_id", "seq", F.round(F.col("diff") * 64, 3).alias("diff"), "moved", "cut")


W2 = f"""WITH {V.ctes('frames')}, b AS (SELECT *, lag(luma) {W} AS old FROM frames), x AS (SELECT stream_id, seq, CASE WHEN old IS NOT NULL THEN list_sum(list_transform(list_zip(luma, old), lambda p: abs(p[1] - p[2]))) / len(luma) END AS diff FROM b)
  SELECT stream_id, seq, round(diff * 64, 3) AS diff, coalesce(diff > 2, true) AS moved, coalesce(diff > 30, false) AS cut FROM x"""


def w4(s, d):
    return Q.text_delta(V.captures(s, d)).select("stream_id", "seq", "delta")


W4 = f"""WITH {CAP}, b AS (SELECT *, trim(text) AS now, trim(lag(text) {W}) AS old FROM captures)
  SELECT stream_id, seq, CASE WHEN length(old) > 0 AND starts_with(now, old) THEN trim(substr(now, length(old) + 1)) ELSE now END AS delta FROM b"""


def t24(s, d):
    return Q.text_delta(V.captures(s, d)).select("stream_id", "seq", "tail")


_WL = lambda c: f"list_filter(string_split_regex({c}, '[ \\t\\n]+'), lambda w: w <> '')"
T24 = f"""WITH {CAP}, b AS (SELECT stream_id, seq, {_WL('text')} AS w, {_WL(f"coalesce(lag(text) {W}, '')")} AS o FROM captures),
  m AS (SELECT *, coalesce(list_min(list_filter(list_transform(range(1, least(len(w), len(o)) + 1), lambda i: CASE WHEN w[i] = o[i] THEN NULL ELSE i END), lambda i: i IS NOT NULL)) - 1, least(len(w), len(o))) AS n FROM b)
  SELECT stream_id, seq, array_to_string(list_slice(w, n + 1, len(w)), ' ') AS tail FROM m"""


def w5(s, d):
    return Q.stable_runs(V.captures(s, d)).select("stream_id", F.col("run").cast("long").alias("run"), "key", "n", "first_seq")


W5 = f"""WITH {CAP}, k AS (SELECT *, {KEY('text')} AS key FROM captures), f AS (SELECT *, coalesce(CAST(lag(key) {W} <> key AS INTEGER), 1) AS new FROM k), r AS (SELECT *, CAST(sum(new) {W} AS BIGINT) AS run FROM f)
  SELECT stream_id, run, key, count(*) AS n, min(seq) AS first_seq FROM r GROUP BY stream_id, run, key HAVING count(*) >= 2"""


def w6(s, d):
    return Q.repeats_last(V.captures(s, d)).select("stream_id", "seq", "repeat")


W6 = f"WITH {CAP}, b AS (SELECT stream_id, seq, text, coalesce(lag(text) {W}, '') AS old FROM captures) SELECT stream_id, seq, ({OVERLAP('old', 'text')}) > 0.7 AS repeat FROM b"


def w7(s, d):
    return Q.heard_before(V.speech(s, d)).select("stream_id", "seq", "own")


W7 = f"""WITH {V.ctes('speech')}, n AS (SELECT stream_id, seq, text, row_number() {W} AS r FROM speech)
  SELECT a.stream_id, a.seq, coalesce(bool_or(b.seq IS NOT NULL AND ({OVERLAP("coalesce(b.text, '')", 'a.text')}) > 0.6), false) AS own FROM n a LEFT JOIN n b ON a.stream_id = b.stream_id AND b.r BETWEEN a.r - 16 AND a.r - 1 GROUP BY a.stream_id, a.seq"""


def w8(s, d):
    return Q.reading_order(V.boxes(s, d))


W8 = f"""WITH {V.ctes('boxes')}, m AS (SELECT frame_id, quantile_cont(y1 - y0, 0.5) AS tall FROM boxes GROUP BY frame_id), p AS (SELECT boxes.*, tall, (y0 + y1) / 2 AS yc FROM boxes JOIN m USING (frame_id)),
  g AS (SELECT *, coalesce(CAST(yc - lag(yc) OVER (PARTITION BY frame_id ORDER BY yc, x0, pos) > greatest(8.0, 0.6 * tall) AS INTEGER), 1) AS new FROM p),
  r AS (SELECT *, sum(new) OVER (PARTITION BY frame_id ORDER BY yc, x0, pos) AS row FROM g), l AS (SELECT frame_id, row, string_agg(text, ' ' ORDER BY x0, pos) AS line FROM r GROUP BY frame_id, row)
  SELECT frame_id, count(*) AS n_rows, string_agg(line, chr(10) ORDER BY row) AS text FROM l GROUP BY frame_id"""


def w9(s, d):
    return Q.merge_boxes(V.boxes(s, d))


def w10(s, d):
    return Q.name_lines(explode_lines(V.table(s, d, "documents")))


W10 = f"""WITH {LINES}, b AS (SELECT *, len(list_filter(string_split(lead(line) OVER (PARTITION BY doc_id ORDER BY line_no), ' '), lambda x: x <> '')) AS after FROM lines)
  SELECT doc_id, line_no, line FROM b WHERE {has('line', r'^\p{Lu}[\p{L}]{1,14}[.:]?$')} AND after >= 3"""


def w11(s, d):
    return Q.without_tiles(V.boxes(s, d)).groupBy("frame_id").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


W11 = f"WITH {V.ctes('boxes')}, g AS (SELECT *, y0 - lag(y0) OVER (PARTITION BY frame_id, text ORDER BY y0, x0, pos) AS gap FROM boxes) SELECT frame_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM g WHERE gap IS NULL OR gap >= 20 GROUP BY frame_id"


def w12(s, d):
    return Q.bands(events(s, d).select("event_type", "event_id", "value"), "event_type", "event_id", F.col("value") > 100, few_keys=True)


W12 = """WITH n AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events), p AS (SELECT *, n - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM n WHERE value > 100)
  SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM p GROUP BY event_type, run"""


def w13(s, d):
    return Q.service_states(events(s, d).select(F.col("event_type").alias("service"), "ts", F.col("event_id").alias("id"), (F.col("value") / 100).alias("latency"))).select("service", "id", "state", "before")


STATE = "CASE WHEN value / 100 <= 1.5 THEN 'fast' WHEN value / 100 <= 4 THEN 'slow' ELSE 'offline' END"
W13 = f"WITH s AS (SELECT event_type AS service, ts, event_id AS id, {STATE} AS state FROM events), b AS (SELECT *, lag(state) OVER (PARTITION BY service ORDER BY ts, id) AS before FROM s) SELECT service, id, state, before FROM b WHERE before IS NULL OR before <> state"


def w12_groups(s, d):
    runs = Q.bands(events(s, d).select("user_id", "event_id", "value"), "user_id", "event_id", F.col("value") > 250)
    return Q.band_groups(runs, "user_id")


_RUNS = """n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), p AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM n WHERE value > 250),
  r AS (SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM p GROUP BY user_id, run), g AS (SELECT *, first - lag(last) OVER (PARTITION BY user_id ORDER BY first) - 1 AS gap FROM r), l AS (SELECT user_id, greatest(5.0, round_even(1.7 * quantile_cont(gap, 0.5), 0)) AS most FROM g GROUP BY user_id),
  j AS (SELECT g.*, sum(coalesce(CAST(gap > most AS INTEGER), 1)) OVER (PARTITION BY g.user_id ORDER BY first) AS grp FROM g JOIN l ON l.user_id = g.user_id), groups AS (SELECT user_id, min(first) AS first, max(last) AS last, CAST(sum(n) AS BIGINT) AS n, count(*) AS runs FROM j GROUP BY user_id, grp)"""
W12G = f"WITH {_RUNS} SELECT user_id, first, last, n, runs FROM groups"


def w12_lowest(s, d):
    return Q.lowest_group(w12_groups(s, d), "user_id", F.col("first") > 400)


W12L = f"WITH {_RUNS} SELECT user_id, first, last, n FROM groups WHERE first > 400 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY first DESC) = 1"
#: Every third line of a document is headed by a name on its own box.
NAMED = "CASE line_no % 3 WHEN 0 THEN 'Anna Mond' WHEN 1 THEN 'the end' ELSE 'Stop.' END"


def named_boxes(s, d):
    rows = explode_lines(V.table(s, d, "documents")).selectExpr("doc_id * 1000000 + line_no div 3 AS frame_id", "line_no", "line", f"{NAMED} AS name")
    both = rows.selectExpr("frame_id", "line_no * 2 AS pos", "cast(0 AS double) AS x0", "cast(line_no * 40 AS double) AS y0", "cast(line_no * 40 + 14 AS double) AS y1", "name AS text")
    return both.unionByName(rows.selectExpr("frame_id", "line_no * 2 + 1 AS pos", "cast(0 AS double) AS x0", "cast(line_no * 40 + 18 AS double) AS y0", "cast(line_no * 40 + 32 AS double) AS y1", "line AS text"))


_NAMED = f"""{LINES}, b AS (SELECT doc_id * 1000000 + line_no // 3 AS frame_id, line_no * 2 AS pos, CAST(line_no * 40 AS DOUBLE) AS y0, CAST(line_no * 40 + 14 AS DOUBLE) AS y1, {NAMED} AS text FROM lines UNION ALL SELECT doc_id * 1000000 + line_no // 3, line_no * 2 + 1, line_no * 40 + 18, line_no * 40 + 32, line FROM lines),
  o AS (SELECT *, trim(lead(text) OVER w) AS after, lead(y0) OVER w AS top FROM b WINDOW w AS (PARTITION BY frame_id ORDER BY y0, pos)), c AS (SELECT * FROM o WHERE {has('trim(text)', r'^\p{Lu}[^\s\d{}\[\]<>=_/\\|]*( \p{Lu}[^\s\d{}\[\]<>=_/\\|]*){0,2}$')} AND length(trim(text)) <= 20 AND NOT {has('trim(text)', '[.,!?:;…]$')}
    AND len(list_filter(string_split_regex(after, '\\s+'), lambda x: x <> '')) >= 3 AND length(after) >= 12 AND length(after) > length(trim(text)) AND top > y0 AND top - y1 <= 2 * (y1 - y0)),
  f AS (SELECT frame_id, trim(text) AS name, pos FROM c QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY y0, pos) = 1)"""
W10S = f"WITH {_NAMED} SELECT frame_id, name, CAST(pos AS INTEGER) AS pos FROM f"
W10T = f"WITH {_NAMED} SELECT b.frame_id, count(*) AS n FROM b LEFT JOIN f ON f.frame_id = b.frame_id AND f.pos = b.pos WHERE f.pos IS NULL GROUP BY b.frame_id"


def w14(s, d):
    rows = V.table(s, d, "documents").select("source", "doc_id", (F.col("n_chars") * 200).alias("bytes"))
    return Q.retain(rows, "source", "doc_id", "bytes", 60, 24 << 20).select("source", "doc_id", F.col("nth").cast("long").alias("nth"), "held")


def w14_lines(s, d):
    """The last 200 lines of each source."""
    rows = explode_lines(V.table(s, d, "documents"), keep=("source",)).select("source", (F.col("doc_id") * 1000000 + F.col("line_no")).alias("at"))
    return Q.retain(rows, "source", "at", most=200).select("source", "at", F.col("nth").cast("long").alias("nth"))


W14 = "SELECT source, doc_id, nth, held FROM (SELECT source, doc_id, row_number() OVER w AS nth, CAST(sum(n_chars * 200) OVER w AS BIGINT) AS held FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC)) WHERE nth <= 60 AND held <= 25165824"


def w15(s, d):
    return Q.backlog(V.speech(s, d), 0.5, 5.0).select("stream_id", "seq", F.round("queued", 6).alias("queued"), "over")


W15 = f"""WITH {V.ctes('speech')}, x AS (SELECT stream_id, seq, greatest(CAST(sum(CAST(t1 - t0 AS DOUBLE) / 1000) OVER (PARTITION BY stream_id ORDER BY t0, seq) - CAST(t0 - min(t0) OVER (PARTITION BY stream_id) AS DOUBLE) / 1000 * 0.5 AS DOUBLE), 0) AS queued FROM speech)
  SELECT stream_id, seq, round(queued, 6) AS queued, queued > 5 AS over FROM x"""


def w16(s, d):
    return reports.last_voice(V.subtitles(s, d), V.speech(s, d))


W16 = f"""WITH {V.ctes('subtitles')}, b AS (SELECT stream_id, t, seq, CAST(NULL AS BIGINT) AS heard FROM subtitles UNION ALL SELECT stream_id, t1, seq, t1 FROM speech), m AS (SELECT *, max(heard) OVER (PARTITION BY stream_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS last FROM b)
  SELECT stream_id, seq, coalesce(t - last <= 1200, false) AS voiced, t - last AS age FROM m WHERE heard IS NULL"""


def k1(s, d):
    return events(s, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")


def k2(s, d):
    return reports.best_block(explode_lines(V.table(s, d, "documents")))


def _k2() -> str:
    from captext.plans.text_queries import QUERIES

    keep = QUERIES["f2_utterances"][1].split("WHERE ", 3)[-1]
    rank = f"CASE WHEN {has('line', '[.?!…]')} THEN 2.0 ELSE 0.0 END + least(1.0, len(list_filter(string_split(line, ' '), lambda x: x <> '')) / 8.0)"
    return f"WITH {LINES}, r AS (SELECT *, CAST({rank} AS DOUBLE) AS rank FROM lines WHERE {keep}) SELECT doc_id, line, rank FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, line_no) = 1"


def k3(s, d):
    rows = events(s, d).where("event_id % 2 = 1").withColumn("volume", F.col("value") / 500).withColumn("tick", F.expr("day(ts) * 100 + hour(ts)"))
    return Q.pick_targets(rows, "tick", "event_id", F.col("event_id") % 11 == 0, F.col("event_type") == "click", F.col("event_type") == "error")


K3 = """SELECT tick, event_id, kind FROM (SELECT CAST(day(ts) * 100 + hour(ts) AS INTEGER) AS tick, event_id, value, CASE WHEN event_id % 11 = 0 THEN 2 WHEN event_type = 'click' THEN 1 ELSE 0 END AS kind FROM events WHERE event_id % 2 = 1 AND event_type <> 'error' AND value / 500 > 0.001)
  QUALIFY row_number() OVER (PARTITION BY tick ORDER BY kind DESC, value DESC, event_id) = 1"""


def k4(s, d):
    good = F.col("result").isNotNull() & (F.trim("result") != "") & ~F.col("result").rlike(r"^\[.*failed") & F.col("result").startswith(">>")
    return reports.first_accepted(V.providers(s, d), "doc_id", good)


GOOD = f"result IS NOT NULL AND trim(result) <> '' AND NOT {has('result', r'^\[.*failed')} AND starts_with(result, '>>')"
K4 = f"""WITH {V.ctes('providers')}, g AS (SELECT doc_id, rank, result FROM providers WHERE {GOOD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank) = 1)
  SELECT d.doc_id, rank, coalesce(result, '[failed]') AS result FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id"""


def k5(s, d):
    verified = F.col("text").rlike("^[A-Z][a-z]+$")
    quality = scoring.candidate_quality(F.col("text"), T.LATIN, F.col("conf") / 100, verified)
    kept = scoring.accepts(F.col("text"), scoring.covered_confidence(F.col("conf") / 100, F.expr("cast(pos AS double) / 40")))
    rows = V.boxes(s, d).withColumn("quality", quality).where(kept)
    return rows.groupBy("frame_id").agg(F.max_by("pos", F.struct(F.round("quality", 9), -F.col("pos"))).alias("pos"), F.round(F.max("quality"), 6).alias("quality"))


_N = "len(regexp_extract_all(text, '\\p{L}'))"
K5 = f"""WITH {V.ctes('boxes')}, q AS (SELECT frame_id, pos, CAST(CASE WHEN {_N} > 0 THEN len(regexp_extract_all(text, '[A-Za-z]')) / {_N} ELSE 0 END AS DOUBLE) + CAST(least(length(text) * 0.01, 0.12) AS DOUBLE) + CASE WHEN {has('text', '^[A-Z][a-z]+$')} THEN CAST(0.2 AS DOUBLE) ELSE 0 END + conf / 100 AS quality,
  conf / 100 * (1 - 0.4 * greatest(0, least(1, (CAST(pos AS DOUBLE) / 40 - 0.5) / 0.5))) AS kept, {_N} AS n FROM boxes)
  SELECT frame_id, pos, round(quality, 6) AS quality FROM q WHERE kept >= CASE WHEN n BETWEEN 1 AND 3 THEN 0.12 ELSE 0.25 END QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY round(quality, 9) DESC, pos) = 1"""


def k6(s, d):
    return reports.worst_lines(explode_lines(V.table(s, d, "documents")))


def _k6() -> str:
    from captext.plans.text_queries import VALID, n

    return f"WITH {LINES}, b AS (SELECT doc_id, line_no, {n('line', r'\p{L}')} AS letters FROM lines WHERE NOT ({VALID})) SELECT doc_id, line_no, letters FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY letters DESC, line_no) <= 6"


def u2(s, d):
    return reports.distinct_keys(explode_lines(V.table(s, d, "documents")), "line")


def u3(s, d):
    return reports.new_keys(V.captures(s, d), V.playback(s, d))


U3 = f"WITH {V.ctes('captures', 'playback')} SELECT DISTINCT stream_id, {KEY('text')} AS key FROM captures EXCEPT SELECT stream_id, {KEY('text')} FROM playback"


def u4(s, d):
    return Q.append_new(V.captures(s, d)).select("stream_id", "seq")


U4 = f"""WITH {CAP}, n AS (SELECT stream_id, seq, text, row_number() {W} AS r FROM captures)
  SELECT a.stream_id, a.seq FROM n a LEFT JOIN n b ON a.stream_id = b.stream_id AND b.r BETWEEN a.r - 10 AND a.r - 1 AND contains(b.text, a.text) GROUP BY a.stream_id, a.seq HAVING count(b.seq) = 0"""

QUERIES = {
    "w1_text_changes": (w1, W1),
    "w1_frame_reuse": (w1_frames, W1F),
    "w2_frame_difference": (w2, W2),
    "w4_text_delta": (w4, W4),
    "t24_growth_tail": (t24, T24),
    "w5_stable_runs": (w5, W5),
    "w6_repeats_last": (w6, W6),
    "w7_heard_before": (w7, W7),
    "w8_reading_order": (w8, W8),
    "w9_merge_boxes": (w9, None),
    "w10_name_lines": (w10, W10),
    "w11_tiles": (w11, W11),
    "w12_bands": (w12, W12),
    "w13_service_states": (w13, W13),
    "w12_groups": (w12_groups, W12G),
    "w12_lowest": (w12_lowest, W12L),
    "w10_speakers": (lambda s, d: Q.speakers(named_boxes(s, d)), W10S),
    "w10_without_names": (lambda s, d: Q.without_speakers(b := named_boxes(s, d), Q.speakers(b)).groupBy("frame_id").agg(F.count("*").alias("n")), W10T),
    "w8_exact_order": (lambda s, d: Q.reading_order_exact(V.boxes(s, d)), None),
    "w14_lines": (w14_lines, f"WITH {LINES} SELECT source, lines.doc_id * 1000000 + line_no AS at, row_number() OVER (PARTITION BY source ORDER BY lines.doc_id * 1000000 + line_no DESC) AS nth FROM lines JOIN documents ON documents.doc_id = lines.doc_id QUALIFY nth <= 200"),
    "w14_history": (lambda s, d: Q.newest(V.table(s, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", most=500), "SELECT conv_id, turn FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 500"),
    "w14_retention": (w14, W14),
    "w15_backlog": (w15, W15),
    "w16_last_voice": (w16, W16),
    "k1_recent": (k1, "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50"),
    "k2_best_block": (k2, _k2()),
    "k3_target": (k3, K3),
    "k4_first_accepted": (k4, K4),
    "k5_candidate": (k5, K5),
    "k6_rejected": (k6, _k6()),
    "u2_distinct_chunks": (u2, f"WITH {LINES} SELECT DISTINCT {KEY('line')} AS key FROM lines WHERE length({KEY('line')}) > 3"),
    "u3_new_minus_known": (u3, U3),
    "u4_append_new": (u4, U4),
}
