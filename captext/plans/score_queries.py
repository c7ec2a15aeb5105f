"""Queries over scores, classes, aggregates and sources, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captext.functions import text as T
from captext.functions.spoken import BETWEEN, spoken_form, spoken_rules
from captext.operators import fusion, lexicon, reports, scoring
from captext.operators.lines import explode_lines
from captext.plans import views as V
from captext.plans.join_queries import OVERLAP, frame, values
from captext.plans.text_queries import _ABC, _CYR, LINES, WORDS, has, n, q, sub

KEYWORDS = (("happy", 0, "ing"), ("happy", 0, "joy"), ("sad", 1, "ment"), ("sad", 1, "tear"), ("angry", 2, "hate"), ("surprised", 3, "wow"), ("thinking", 4, "tion"), ("scared", 5, "ung"))
CURSES = ["idiot", "moron"]
CLASSES = [("fear", ["ung", "schr"]), ("joy", ["ing", "eau"]), ("grief", ["ment", "ado"])]
SITUATIONS = [("battle", "idiot|moron|clown"), ("travel", "tion|ción"), ("trade", "[0-9]+"), ("magic", "eau|schw"), ("talk", "the|und|que")]
EMOTIONS = (("shout", 20, 10), ("fear", 15, 8), ("joy", 10, 5), ("grief", -15, -6), ("surprise", 5, 12), ("normal", 0, 0))
SHORT = (("the", "the whole"), ("of", "out of"), ("und", "und auch"), ("que", "lo que"))
UTTERANCE = ("conv_id", "turn", "text", "turn % 2 = 0 AS has_voice", "CASE WHEN turn % 2 = 0 THEN substr(text, 1, 40) ELSE '' END AS voice_text", "cast(turn % 4 AS int) AS stability", "cast(turn % 5 AS double) / 4 AS screen_pos", "cast(turn % 7 AS double) AS age", "turn % 11 = 0 AS is_echo")


def docs(s, d) -> DataFrame:
    return V.table(s, d, "documents")


def t27(s, d):
    return scoring.decide_utterances(V.table(s, d, "conversations").selectExpr(*UTTERANCE)).select("conv_id", "turn", "action", F.round("score", 6).alias("score"), "pros", "cons")


def _t27() -> str:
    t, w = "trim(text)", "regexp_extract_all(trim(text), '[\\p{L}\\p{N}_]+')"
    han = n(t, r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]")
    yes = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"
    clamp = lambda c: f"greatest(0.0, least(1.0, {c}))"
    count = f"(len({w}) + {han} // 2)"
    plain = f"{count} >= 2 AND {n(t, r'\p{L}')} >= 3 AND len(list_filter({w}, lambda x: length(x) <= 2)) <= len({w}) * 0.5 AND len(list_filter({w}, lambda x: {has('x', r'\p{Nd}')})) = 0 AND {n(t, r'\p{Nd}')} <= greatest(1, {n(t, r'\p{L}')} // 4)"
    f = {
        "words": yes(f"{count} >= 1"), "length": clamp(f"{count} / 6.0"), "dialog_marks": yes(has(t, "[.?!…]")), "sentence_start": yes(f"{has(t, r'^\p{Lu}')} OR {han} > 0"), "screen_pos": clamp("screen_pos"),
        "stability": clamp("stability / 3.0"), "freshness": clamp("1.0 - age / 5.0"), "not_gibberish": yes(f"{han} >= 2 OR ({plain})"), "has_voice": yes("has_voice"), "voice_text": yes(f"{n('voice_text', r'[\p{L}\p{N}_]+')} >= 2"),
        "overlap_voice": f"({OVERLAP('voice_text', 'text')})", "not_echo": yes("NOT is_echo"),
    }
    total = " + ".join(f"CAST({k}_ AS DOUBLE) * CAST({w} AS DOUBLE)" for k, w in scoring.WEIGHTS.items())
    told = lambda sign, when, much: "array_to_string(list_slice(list_filter([" + ", ".join(f"CASE WHEN {k}_ {when} 0.5 THEN printf('{k}{sign}%.2f', floor(CAST({w} AS DOUBLE) * CAST({much.format(k + '_')} AS DOUBLE) * 100 + 0.5) / 100) END" for k, w in scoring.WEIGHTS.items()) + "], lambda x: x IS NOT NULL), 1, 4), ' ')"
    return f"""WITH u AS (SELECT {', '.join(UTTERANCE)} FROM conversations), f AS (SELECT conv_id, turn, is_echo OR trim(text) = '' AS hard, {', '.join(f'({x}) AS {k}_' for k, x in f.items())} FROM u), s AS (SELECT *, ({total}) / {sum(scoring.WEIGHTS.values())} AS score FROM f)
      SELECT conv_id, turn, CASE WHEN hard THEN 'skip' WHEN score >= 0.55 THEN 'speak' WHEN score >= 0.30 THEN 'refine' ELSE 'skip' END AS action, round(CASE WHEN hard THEN 0.0 ELSE score END, 6) AS score,
      CASE WHEN hard THEN '' ELSE {told('+', '>=', '{}')} END AS pros, CASE WHEN hard THEN '' ELSE {told('-', '<', '(1.0 - {})')} END AS cons FROM s"""


def a2(s, d):
    return scoring.keyword_emotion(docs(s, d), frame(s, KEYWORDS, "emotion string, ord int, stem string"), CURSES)


A2 = f"""WITH k AS (SELECT * FROM {values(KEYWORDS, 'emotion, ord, stem')}), s AS (SELECT doc_id, emotion, min(ord) AS ord, any_value(text) AS text, count(*) FILTER (WHERE contains(lower(text), stem))
    + CASE WHEN emotion = 'angry' AND any_value({has('lower(text)', '|'.join(CURSES))}) THEN 2.0 ELSE 0.0 END + CASE WHEN contains(any_value(text), '?') THEN CASE emotion WHEN 'thinking' THEN 1.0 WHEN 'surprised' THEN 0.5 ELSE 0.0 END ELSE 0.0 END AS score FROM documents, k GROUP BY doc_id, emotion),
  t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1) SELECT doc_id, CASE WHEN score + CASE WHEN contains(text, '!') AND score > 0 THEN 1 ELSE 0 END >= 1 THEN emotion ELSE 'neutral' END AS emotion FROM t"""


def a3(s, d):
    return explode_lines(docs(s, d)).select("doc_id", "line_no", scoring.priority_emotion(F.col("line"), CLASSES).alias("emotion"))


#: RE2 has no back-references: a letter four times, letter by letter.
FOUR_TIMES = "|".join(f"{c}{{4}}" for c in "abcdefghijklmnopqrstuvwxyzàâäçéèêëïîôöùûüÿßñáíóúабвгдеёжзийклмнопрстуфхцчшщъыьэюя")
EMOTION = f"CASE WHEN {has('line', r'\p{Lu}{2,}')} OR {has('lower(line)', FOUR_TIMES)} THEN 'shout' " + " ".join(f"WHEN {has('lower(line)', '|'.join(stems))} THEN {q(name)}" for name, stems in CLASSES) + " WHEN contains(line, '?') THEN 'surprise' ELSE 'normal' END"


def a4(s, d):
    return docs(s, d).select("lang", F.explode(scoring.situations(F.col("text"), SITUATIONS)).alias("situation")).groupBy("lang", "situation").agg(F.count("*").alias("n"))


_FOUND = "list_filter([" + ", ".join(f"CASE WHEN {has('lower(text)', p)} THEN {q(name)} END" for name, p in SITUATIONS) + "], lambda x: x IS NOT NULL)"
A4 = f"WITH x AS (SELECT lang, unnest(CASE WHEN len({_FOUND}) > 0 THEN {_FOUND} ELSE ['narrator'] END) AS situation FROM documents) SELECT lang, situation, count(*) AS n FROM x GROUP BY lang, situation"


def corrections(s, d):
    return V.table(s, d, "events").selectExpr("event_id AS seq", "concat('v', user_id % 5) AS new_voice", "concat('v', (user_id + event_id) % 5) AS old_voice", "event_type AS situation")


CORRECTIONS = "corrections AS (SELECT event_id AS seq, concat('v', user_id % 5) AS new_voice, concat('v', (user_id + event_id) % 5) AS old_voice, event_type AS situation FROM events)"


def a5(s, d):
    return scoring.preference_scores(corrections(s, d))


A5X = f"""{CORRECTIONS}, x AS (SELECT seq, situation, new_voice AS voice, 1 AS delta FROM corrections UNION ALL SELECT seq, situation, old_voice, -1 FROM corrections),
  f AS (SELECT *, min(CASE WHEN delta = 1 THEN seq END) OVER (PARTITION BY situation, voice) AS first FROM x), p AS (SELECT voice, situation, CAST(sum(delta) AS BIGINT) AS score FROM f WHERE delta = 1 OR first < seq GROUP BY voice, situation)"""
A5 = f"WITH {A5X} SELECT voice, situation, score FROM p"
A5B = f"WITH {A5X} SELECT situation, voice, score FROM p WHERE score > -1 QUALIFY row_number() OVER (PARTITION BY situation ORDER BY score DESC, voice) = 1"


VOICES = (("v0", "male"), ("v1", "female"), ("v2", "male"), ("v3", "female"), ("v4", "male"))


def a5_pick(s, d):
    asked = V.table(s, d, "conversations").selectExpr("conv_id * 1000 + turn AS id", "CASE turn % 4 WHEN 0 THEN array('dialogue_male', 'view') WHEN 1 THEN array('dialogue_female', 'click', 'purchase') WHEN 2 THEN array('narrator') ELSE array('click', 'view') END AS situations")
    return scoring.pick_voice(asked, a5(s, d), frame(s, VOICES, "voice string, gender string"), "v3")


A5P = f"""WITH {A5X}, q AS (SELECT conv_id * 1000 + turn AS id, CASE turn % 4 WHEN 0 THEN ['dialogue_male', 'view'] WHEN 1 THEN ['dialogue_female', 'click', 'purchase'] WHEN 2 THEN ['narrator'] ELSE ['click', 'view'] END AS situations FROM conversations),
  k AS (SELECT DISTINCT situations, CASE WHEN list_contains(situations, 'dialogue_male') THEN 'male' WHEN list_contains(situations, 'dialogue_female') THEN 'female' END AS wants FROM q), v AS (SELECT * FROM {values(VOICES, 'voice, gender')}),
  t AS (SELECT situations, v.voice, coalesce((SELECT sum(score) FROM p WHERE p.voice = v.voice AND list_contains(situations, p.situation)), 0) + CASE WHEN wants = gender THEN 10 ELSE 0 END + CASE WHEN list_contains(situations, 'narrator') AND v.voice = 'v3' THEN 10 ELSE 0 END AS s FROM k, v WHERE wants IS NULL OR wants = gender),
  b AS (SELECT situations, voice FROM t QUALIFY row_number() OVER (PARTITION BY situations ORDER BY s DESC, voice) = 1) SELECT id, voice FROM q JOIN b USING (situations)"""


def a1(s, d):
    return reports.batch_summary(V.table(s, d, "pages").select(F.length("html").alias("chars"), F.size(F.split("html", "\n")).alias("lines"), (F.length("html") > 0).alias("success")))


A1 = "SELECT count(*) AS total, count(*) FILTER (WHERE length(html) > 0) AS ok, count(*) FILTER (WHERE NOT length(html) > 0) AS failed, CAST(sum(length(html)) AS BIGINT) AS chars, CAST(sum(len(string_split(html, chr(10)))) AS BIGINT) AS lines FROM pages"


def s2(s, d):
    return V.table(s, d, "pages").select("page_id", F.length("html").cast("long").alias("chars"), F.size(F.split("html", "\n")).cast("long").alias("lines"))


def a9(s, d):
    return reports.best_pass(V.captures(s, d).withColumn("pass", F.col("seq") % 3)).select("stream_id", "pass", F.length("text").cast("long").alias("chars"))


A9 = f"""WITH {V.ctes('captures')}, p AS (SELECT stream_id, seq % 3 AS pass, avg(conf) AS conf, string_agg(text, ' ' ORDER BY seq) AS text FROM captures GROUP BY 1, 2)
  SELECT stream_id, pass, length(text) AS chars FROM p QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY round(conf, 9) DESC, pass) = 1"""


def a10(s, d):
    return reports.region_texts(V.captures(s, d).withColumn("region", F.col("seq") % 4))


A10 = f"""WITH {V.ctes('captures')}, l AS (SELECT stream_id, seq % 4 AS region, arg_max(text, t) AS text FROM captures GROUP BY 1, 2) SELECT stream_id, string_agg(concat('[', region, '] ', text), chr(10) ORDER BY region) AS text FROM l GROUP BY stream_id"""


def a11(s, d):
    health = scoring.provider_health(V.providers(s, d), F.coalesce(F.col("result").startswith(">>"), F.lit(False)))
    return health.select("provider", "n", "n_ok", F.round("mean_ms", 6).alias("mean_ms"), F.round("p95_ms", 6).alias("p95_ms"), "langs")


OK = "coalesce(starts_with(result, '>>'), false)"
A11 = f"WITH {V.ctes('providers')} SELECT provider, count(*) AS n, count(*) FILTER (WHERE {OK}) AS n_ok, round(avg(latency_ms), 6) AS mean_ms, round(CAST(quantile_cont(latency_ms, 0.95) AS DOUBLE), 6) AS p95_ms, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang) FILTER (WHERE {OK}), '') AS langs FROM providers GROUP BY provider"


def vectors(s, d):
    return V.table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("samples"))


def a12(s, d):
    e = scoring.frame_energy()
    return vectors(s, d).select("vec_id", F.round(e["db"], 6).alias("db"), F.round(e["peak"], 6).alias("peak"), (e["peak"] < 0.005).alias("silent"), (e["rms"] >= 0.01).alias("voice"))


_RMS = "sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / len(embedding))"
_PEAK = "list_max(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE))))"
A12 = f"SELECT vec_id, round(greatest(-60.0, 20 * log10(greatest({_RMS}, 1e-6))), 6) AS db, round({_PEAK}, 6) AS peak, {_PEAK} < 0.005 AS silent, {_RMS} >= 0.01 AS voice FROM embeddings"


def a13(s, d):
    return scoring.spectrum(vectors(s, d)).select("vec_id", F.round("centroid", 4).alias("centroid"), F.round("bandwidth", 4).alias("bandwidth"), "rolloff", F.round("flatness", 6).alias("flatness"))


A13 = """WITH b AS (SELECT k, n, cos(2 * pi() * k * n / 64) * (0.5 - 0.5 * cos(2 * pi() * n / 63)) AS c, sin(2 * pi() * k * n / 64) * (0.5 - 0.5 * cos(2 * pi() * n / 63)) AS s FROM range(0, 33) x(k), range(0, 64) y(n)),
  l AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings), f AS (SELECT vec_id, k * 16000.0 / 64 AS hz, sqrt(sum(CAST(v AS DOUBLE) * c) ^ 2 + sum(CAST(v AS DOUBLE) * s) ^ 2) AS m FROM l JOIN b USING (n) GROUP BY vec_id, k),
  u AS (SELECT *, sum(m) OVER (PARTITION BY vec_id ORDER BY hz) AS upto, sum(m) OVER (PARTITION BY vec_id) AS a FROM f), g AS (SELECT vec_id, sum(hz * m) / sum(m) AS c, sum(hz * hz * m) / sum(m) AS second, min(hz) FILTER (WHERE upto >= 0.85 * a) AS rolloff, least(1.0, exp(avg(ln(m + 1e-10))) / (avg(m) + 1e-10)) AS flat FROM u GROUP BY vec_id)
  SELECT vec_id, round(c, 4) AS centroid, round(sqrt(greatest(second - c * c, 0.0)), 4) AS bandwidth, CAST(rolloff AS DOUBLE) AS rolloff, round(flat, 6) AS flatness FROM g"""


def a14(s, d):
    return scoring.pitch_lags(vectors(s, d)).select("vec_id", "lag", F.round("r", 6).alias("r"))


A14 = """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), e AS (SELECT *, list_sum(list_transform(x, lambda v: v * v)) AS e FROM x), l AS (SELECT vec_id, x, e, unnest(range(8, 33)) AS lag FROM e WHERE e > 0),
  r AS (SELECT vec_id, lag, round(list_sum(list_transform(range(1, 65 - lag), lambda i: x[i] * x[i + lag])) / e, 9) AS r FROM l) SELECT vec_id, CAST(lag AS INTEGER) AS lag, round(r, 6) AS r FROM r WHERE r >= 0.3 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, lag) = 1"""
def a14_yin(s, d):
    return scoring.yin_lags(vectors(s, d)).select("vec_id", "lag", F.round("conf", 6).alias("conf"))


_YIN = """x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), c AS (SELECT vec_id, list_transform(x, lambda v: v - list_sum(x) / len(x)) AS x FROM x), t AS (SELECT vec_id, x, unnest(range(1, 33)) AS lag FROM c),
  f AS (SELECT vec_id, lag, list_sum(list_transform(range(1, 33), lambda i: (x[i] - x[i + lag]) * (x[i] - x[i + lag]))) AS f FROM t), n AS (SELECT vec_id, lag, round(f / (sum(f) OVER (PARTITION BY vec_id ORDER BY lag) / lag), 9) AS v FROM f),
  y AS (SELECT vec_id, coalesce(min(lag) FILTER (WHERE v < 0.2), CASE WHEN min(v) <= 0.5 THEN arg_min(lag, struct_pack(v := v, lag := lag)) END) AS lag FROM n WHERE lag BETWEEN 8 AND 32 GROUP BY vec_id), yin AS (SELECT y.vec_id, y.lag, greatest(0.0, 1 - v) AS conf FROM y JOIN n ON n.vec_id = y.vec_id AND n.lag = y.lag)"""
A14Y = f"WITH {_YIN} SELECT vec_id, CAST(lag AS INTEGER) AS lag, round(conf, 6) AS conf FROM yin"


def a14_combined(s, d):
    rows = vectors(s, d)
    out = scoring.combined_pitch(rows, scoring.pitch_lags(rows), scoring.yin_lags(rows))
    return out.select("vec_id", F.round("pitch_hz", 4).alias("pitch_hz"), F.round("conf", 6).alias("conf"))


A14C = f"""WITH ac AS (SELECT vec_id, lag, r FROM ({A14})), {_YIN}, j AS (SELECT e.vec_id, 16000.0 / ac.lag AS a, ac.r AS ca, 16000.0 / yin.lag AS b, yin.conf AS cb FROM embeddings e LEFT JOIN ac USING (vec_id) LEFT JOIN yin USING (vec_id))
  SELECT vec_id, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN greatest(a, b) / least(a, b) < 1.3 THEN (a + b) / 2 ELSE least(a, b) END ELSE coalesce(b, a, 0.0) END, 4) AS pitch_hz,
    round(least(1.0, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(ca, cb) * CASE WHEN greatest(a, b) / least(a, b) < 1.3 THEN 1.1 ELSE 0.8 END ELSE coalesce(cb, ca, 0.0) END), 6) AS conf FROM j"""


def a14_steadied(s, d):
    """A label's frames are the windows of one utterance."""
    rows = vectors(s, d)
    windows = scoring.pitch_lags(rows).join(rows.select("vec_id", "label"), "vec_id")
    first = scoring.combined_pitch(rows, scoring.pitch_lags(rows), scoring.yin_lags(rows)).join(rows.select("vec_id", "label"), "vec_id").groupBy("label").agg(F.min_by("pitch_hz", "vec_id").alias("pitch_hz"), F.min_by("conf", "vec_id").alias("conf"))
    return scoring.steadied_pitch(first, windows, "label").select("label", F.round("pitch_hz", 4).alias("pitch_hz"), F.round("conf", 6).alias("conf"))


A14S = f"""WITH w AS (SELECT label, quantile_cont(16000.0 / lag, 0.5) AS m FROM ({A14}) JOIN embeddings USING (vec_id) WHERE r > 0.5 GROUP BY label), f AS (SELECT label, arg_min(pitch_hz, vec_id) AS p, arg_min(conf, vec_id) AS c FROM ({A14C}) JOIN embeddings USING (vec_id) GROUP BY label),
  j AS (SELECT label, p, c, m, c < 0.5 AND m IS NOT NULL AS ask, p > 0 AND abs(m - p) / nullif(p, 0) < 0.2 AS near FROM f LEFT JOIN w USING (label))
  SELECT label, round(CASE WHEN ask AND NOT coalesce(near, false) THEN m ELSE p END, 4) AS pitch_hz, round(CASE WHEN ask AND coalesce(near, false) THEN least(1.0, c + 0.2) WHEN ask THEN 0.6 ELSE c END, 6) AS conf FROM j"""
VOICE = ("event_id", "60 + value * 0.7 AS pitch_hz", "cast(800 + (event_id * 37) % 1600 AS double) AS centroid", "cast(300 + (event_id * 53) % 600 AS double) AS bandwidth", "cast(-60 + (event_id * 29) % 60 AS double) AS energy_db", "cast((event_id * 17) % 40 AS double) / 100 AS flatness", "cast((event_id * 13) % 100 AS double) / 100 AS conf")


def a15(s, d):
    return scoring.voice_class(V.table(s, d, "events").selectExpr(*VOICE)).select("event_id", "gender", "age", "style", F.round("sure", 6).alias("sure"), "label")


_UNSURE = "conf < 0.3 OR p < 30"
A15 = f"""WITH v AS (SELECT {', '.join(VOICE)} FROM events), n AS (SELECT event_id, pitch_hz AS p, centroid AS c, bandwidth AS b, energy_db AS energy, flatness, conf FROM v),
  k AS (SELECT event_id, {scoring.case_sql(scoring.GENDERS, 1, _UNSURE, "'unknown'")} END AS gender, {scoring.case_sql(scoring.AGES, 1, _UNSURE, "'unknown'")} END AS age, {scoring.case_sql(scoring.STYLES, 1, 'conf < 0.3', "'normal'")} ELSE 'normal' END AS style,
    round(({scoring.case_sql(scoring.GENDERS, 2, _UNSURE, '0.0')} END + {scoring.case_sql(scoring.AGES, 2, _UNSURE, '0.0')} END + conf) / 3.0, 6) AS sure FROM n)
  SELECT event_id, gender, age, style, sure, concat_ws(' ', concat_ws(', ', CASE gender WHEN 'male' THEN 'man' WHEN 'female' THEN 'woman' WHEN 'child' THEN 'child' ELSE '?' END, CASE WHEN gender NOT IN ('child', 'unknown') THEN age END),
    CASE style WHEN 'shout' THEN '(shouting)' WHEN 'whisper' THEN '(whispering)' WHEN 'laugh' THEN '(laughing)' WHEN 'cry' THEN '(crying)' END) AS label FROM k"""


def a16(s, d):
    return scoring.otsu(V.table(s, d, "events"), "event_type", "value", 0.0, 500.0)


A16 = """WITH h AS (SELECT event_type, CAST(least(63, floor(value / 500 * 64)) AS INTEGER) AS b, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER w AS wb, sum(n * b) OVER w AS sb, sum(n) OVER (PARTITION BY event_type) AS w, sum(n * b) OVER (PARTITION BY event_type) AS s FROM h WINDOW w AS (PARTITION BY event_type ORDER BY b))
  SELECT event_type, b AS threshold FROM c WHERE w > wb QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(CAST(wb AS DOUBLE) * (w - wb) * (CAST(sb AS DOUBLE) / wb - CAST(s - sb AS DOUBLE) / (w - wb)) ^ 2, 3) DESC, b) = 1"""


def a17(s, d):
    return scoring.stretch(V.table(s, d, "events").select("event_id", "event_type", "value"), "event_type", "value").select("event_id", F.round("value", 4).alias("value"))


A17 = "WITH c AS (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1) SELECT event_id, round(CASE WHEN hi - lo < 10 THEN value ELSE greatest(0.0, least(255.0, (value - lo) / (hi - lo) * 255)) END, 4) AS value FROM events JOIN c USING (event_type)"


#: Frames in colour: green by turns, dark, bright, and with the contrast of a screen.
CHANNELS = ("seq", "transform(luma, x -> x * CASE seq % 6 WHEN 1 THEN 0.2 WHEN 2 THEN 1.7 WHEN 3 THEN 0.5 ELSE 1 END + CASE WHEN seq % 6 = 4 THEN (x - 127) * 20 ELSE 0 END) AS r", "transform(luma, x -> x * CASE seq % 6 WHEN 1 THEN 0.2 WHEN 2 THEN 1.8 WHEN 3 THEN 1.5 ELSE 1 END + CASE WHEN seq % 6 = 4 THEN (x - 127) * 20 ELSE 0 END) AS g")


def a18(s, d):
    rows = V.frames(s, d).selectExpr(*CHANNELS).withColumn("b", F.col("r"))
    return scoring.frame_class(rows).select("seq", "kind", F.round(F.col("mean") * 192, 4).alias("total"), F.round("std", 3).alias("std"))


_EDGE = lambda c: f"(list_sum(list_transform(list_filter(range(0, 64), lambda i: i < 8 OR i >= 56), lambda i: {c}[i + 1])) + list_sum(list_transform(list_filter(range(0, 64), lambda i: i % 8 = 0 OR i % 8 = 7), lambda i: {c}[i + 1]))) / 32"
A18 = f"""WITH {V.ctes('frames')}, c AS (SELECT {', '.join(x.replace('x -> ', 'lambda x: ').replace('transform(', 'list_transform(') for x in CHANNELS)} FROM frames), g AS (SELECT seq, list_transform(range(1, 65), lambda i: (r[i] + g[i] + r[i]) / 3) AS grey, {_EDGE('r')} AS er, {_EDGE('g')} AS eg FROM c),
  m AS (SELECT *, list_sum(grey) / 64 AS mean FROM g), s AS (SELECT *, sqrt(list_sum(list_transform(grey, lambda v: (v - mean) * (v - mean))) / 64) AS std, eg > 100 AND eg > er * 1.2 AS green FROM m)
  SELECT seq, CASE WHEN NOT green AND std > 40 AND mean > 40 AND mean < 220 THEN 'clean' WHEN green THEN 'green' WHEN mean >= 220 THEN 'bright' WHEN mean <= 40 THEN 'dark' ELSE 'low_contrast' END AS kind, round(mean * 192, 4) AS total, round(std, 3) AS std FROM s"""


def pictures(s, d):
    """Sixteen frames after each other as one picture of 32 by 32 pixels."""
    rows = V.frames(s, d).groupBy(F.expr("seq div 16").alias("seq")).agg(F.flatten(F.expr("transform(sort_array(collect_list(struct(seq, luma))), x -> x.luma)")).alias("luma"))
    return rows.where("size(luma) = 1024")


def f17(s, d):
    return scoring.sharpness(V.frames(s, d).withColumn("luma", F.transform("luma", lambda x: (x - 127) * 0.3)))


_AT = lambda dx, dy: f"luma[y * 8 + x + {dy * 8 + dx + 1}]"
F17 = f"""WITH {V.ctes('frames')}, h AS (SELECT seq, list_transform(luma, lambda x: (x - 127) * 0.3) AS luma FROM frames), p AS (SELECT seq, 8 * {_AT(0, 0)} - ({' + '.join(_AT(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy)}) AS l FROM h, range(1, 7) a(x), range(1, 7) b(y))
  SELECT seq, round(var_pop(l), 3) AS sharpness, round(var_pop(l), 3) < 500 AS blurred FROM p GROUP BY seq"""


def f11(s, d):
    return V.speech(s, d).groupBy(reports.speech_verdict("ru").alias("reason")).agg(F.count("*").alias("n"))


F11 = f"WITH {V.ctes('speech')} SELECT CASE WHEN length(text) < 2 THEN 'short' WHEN no_speech > 0.6 THEN 'no_speech' WHEN logprob < -1 THEN 'logprob' WHEN compression > 2.4 THEN 'compression' WHEN lang = 'ru' THEN 'target' ELSE 'kept' END AS reason, count(*) AS n FROM speech GROUP BY 1"


PAIRS = (("the", "le"), ("of", "de"), ("and", "et"), ("der", "le"), ("de", "of"))


def f13(s, d):
    done = lexicon.translate_words(docs(s, d), frame(s, PAIRS, "src string, dst string"), 0.0, keep="given")
    return done.select("doc_id", *(v.alias(k) for k, v in T.translation_faults(F.col("given"), F.col("text")).items()))


F13 = f"""WITH {V.ctes('tokens')}, g AS (SELECT * FROM {values(PAIRS, 'src, dst')}), r AS (SELECT doc_id, string_agg(coalesce(dst, token), ' ' ORDER BY pos) AS r FROM tokens LEFT JOIN g ON lower(token) = src GROUP BY doc_id),
  x AS (SELECT doc_id, r, len({WORDS('text')}) AS n, len({WORDS('r')}) AS m, list_distinct({WORDS('lower(text)')}) AS a, list_distinct({WORDS('lower(r)')}) AS b FROM documents JOIN r USING (doc_id))
  SELECT doc_id, trim(r) = '' AS empty, len(list_filter({WORDS('r')}, lambda w: {has('w', '^[A-Za-z]{3,}$')})) > 0 AS leftover, len(list_intersect(a, b)) > len(a) * 0.5 AS same, m < n * 0.4 AS thin FROM x"""


def f15(s, d):
    from captext.sources import files

    rows = V.table(s, d, "conversations").selectExpr("conv_id", "turn", "text AS source_text", "reverse(text) AS translated_text", "concat(role, ' ', turn) AS ocr_text", "CASE conv_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'ru' END AS source_lang", "'fr' AS target_lang")
    return files.search_history(rows, "AND", ["en", "de"]).select("conv_id", "turn", "source_lang")


F15 = """SELECT conv_id, turn, lang AS source_lang FROM (SELECT *, CASE conv_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'ru' END AS lang FROM conversations)
  WHERE (contains(lower(text), 'and') OR contains(lower(reverse(text)), 'and') OR contains(lower(concat(role, ' ', turn)), 'and')) AND lang IN ('en', 'de')"""


def t16(s, d):
    rows = docs(s, d).select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("pos", "x"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "x.chunk", "x.kind")


_KINDS = lambda c: f"CASE WHEN contains({c}, '?') THEN 'question' WHEN contains({c}, '!') THEN 'exclamation' ELSE 'statement' END"
#: A part ends a chunk by its mark, or before one that would make it too long; only runs of unmarked lines are folded row by row.
T16 = f"""WITH RECURSIVE p AS (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split({sub('text', r'([.!?…])\s+|\n+', chr(92) + '1' + chr(1))}, chr(1)), lambda s: {sub('s', r'^\s+|\s+$', '')}), lambda s: s <> '') AS x FROM documents)),
  q AS (SELECT doc_id, i, x[i] AS part, {has('x[i]', '[.!?…]$')} AS closed FROM p), b AS (SELECT *, coalesce(lag(closed) OVER w, true) AS opens FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY i)), r AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run, row_number() OVER () AS z FROM b),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS k FROM r),
  f AS (SELECT doc_id, run, k, part, closed, part AS held, CAST(NULL AS VARCHAR) AS out FROM n WHERE k = 1 UNION ALL
    SELECT n.doc_id, n.run, n.k, n.part, n.closed, CASE WHEN length(f.held) + length(n.part) > 200 THEN n.part ELSE concat(f.held, ' ', n.part) END, CASE WHEN length(f.held) + length(n.part) > 200 THEN f.held END FROM f JOIN n ON n.doc_id = f.doc_id AND n.run = f.run AND n.k = f.k + 1),
  e AS (SELECT doc_id, run, k, 0 AS o, out AS chunk, {_KINDS('out')} AS kind FROM f WHERE out IS NOT NULL UNION ALL
    SELECT doc_id, run, k, 1, held, CASE WHEN closed THEN {_KINDS('part')} ELSE {_KINDS('held')} END FROM f WHERE closed OR (doc_id, run, k) IN (SELECT (doc_id, run, max(k)) FROM n GROUP BY doc_id, run))
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run, k, o) - 1 AS pos, chunk, kind FROM e"""


#: Abbreviations, units, ranges, drawn-out spellings and symbols put after each line.
UNSPOKEN = "concat(line, ' Dr. No, Mr. X etc. hmmmm Ahhh ', doc_id, ' km ', line_no, '-', doc_id, ' 5kg 7% a_b #1 e.g. z.B. usw. d.h. 3 Std env. 9 seg aprox. pág. 2–3 mm')"


def t19(s, d):
    rows = explode_lines(docs(s, d), keep=("lang",))
    return rows.select("doc_id", "line_no", spoken_form(F.expr(UNSPOKEN), F.col("lang")).alias("value"))


def _t19() -> str:
    def read(lang: str) -> str:
        c = "raw"
        for p, to in spoken_rules(lang):
            c = sub(c, p, to.replace("$", "\\"))
        return f"trim({c})"

    cases = " ".join(f"WHEN {q(lang)} THEN {read(lang)}" for lang in sorted(BETWEEN) if lang != "en")
    return f"WITH {LINES}, r AS (SELECT lines.doc_id, line_no, lang, {UNSPOKEN.replace('doc_id', 'lines.doc_id')} AS raw FROM lines JOIN documents ON documents.doc_id = lines.doc_id) SELECT doc_id, line_no, CASE coalesce(lang, '') {cases} ELSE {read('en')} END AS value FROM r"


def t21(s, d):
    rows = explode_lines(docs(s, d)).withColumn("emotion", scoring.priority_emotion(F.col("line"), CLASSES)).join(frame(s, EMOTIONS, "emotion string, er int, ep int"), "emotion")
    rate, pitch = scoring.prosody(F.col("er"), F.col("ep"), F.expr("cast(doc_id % 7 * 10 - 30 AS int)"), F.expr("cast(doc_id % 5 * 10 - 20 AS int)"), T.sentence_type(F.col("line")))
    return rows.select("doc_id", "line_no", rate.alias("rate"), pitch.alias("pitch"))


_KIND = f"CASE WHEN {has('line', r'\?\s*$')} THEN 'question' WHEN {has('line', r'!\s*$')} THEN 'exclamation' ELSE 'statement' END"
T21 = f"""WITH {LINES}, e AS (SELECT doc_id, line_no, {EMOTION} AS emotion, {_KIND} AS kind FROM lines), j AS (SELECT * FROM e JOIN {values(EMOTIONS, 'emotion, er, ep')} USING (emotion))
  SELECT doc_id, line_no, CAST(greatest(-100, least(100, doc_id % 7 * 10 - 30 + er + CASE kind WHEN 'question' THEN -5 WHEN 'exclamation' THEN 5 ELSE 0 END)) AS INTEGER) AS rate, CAST(greatest(-50, least(50, doc_id % 5 * 10 - 20 + ep + CASE kind WHEN 'question' THEN 12 WHEN 'exclamation' THEN 7 ELSE 0 END)) AS INTEGER) AS pitch FROM j"""
#: Factors of how characters speak.
FACTORS = (("calm", 0.4), ("plain", 1.0), ("lively", 1.4))


def t21_segments(s, d):
    rows = explode_lines(docs(s, d)).withColumn("emotion", scoring.priority_emotion(F.col("line"), CLASSES)).join(frame(s, EMOTIONS, "emotion string, rate int, pitch int"), "emotion")
    rows = rows.withColumn("kind", F.expr("CASE doc_id % 3 WHEN 0 THEN 'calm' WHEN 1 THEN 'plain' ELSE 'lively' END")).join(frame(s, FACTORS, "kind string, factor double"), "kind")
    return scoring.expand_prosody(rows, "line").select("doc_id", "line_no", "part", "rate", "pitch")


T21S = f"""WITH {LINES}, e AS (SELECT doc_id, line_no, line, {EMOTION} AS emotion FROM lines), j AS (SELECT * FROM e JOIN {values(EMOTIONS, 'emotion, rate, pitch')} USING (emotion)), k AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN CAST(0.4 AS DOUBLE) WHEN 1 THEN CAST(1.0 AS DOUBLE) ELSE CAST(1.4 AS DOUBLE) END AS factor,
    list_min([i for i in range(1, length(line) + 1) if {has('substr(lower(line), i, 1)', r'\p{L}')}]) AS begins FROM j),
  n AS (SELECT *, CASE WHEN emotion = 'shout' THEN least(6, greatest(3, coalesce(list_min([i for i in range(1, 7) if substr(lower(line), begins + i, 1) <> substr(lower(line), begins, 1)]), 3))) ELSE 1 END AS parts FROM k), x AS (SELECT *, unnest(range(1, parts + 1)) AS part FROM n)
  SELECT doc_id, line_no, CAST(part AS INTEGER) AS part, CAST(trunc(CASE WHEN emotion = 'shout' THEN 20 + rate * (CAST(part AS DOUBLE) / parts) ELSE rate END * factor) AS INTEGER) AS rate, CAST(trunc(CASE WHEN emotion = 'shout' THEN 8 + pitch * (CAST(part AS DOUBLE) / parts) ELSE pitch END * factor) AS INTEGER) AS pitch FROM x"""
#: Sounds of letters; `e` has another after a consonant.
SOUNDS = (("a", "a"), ("b", "b"), ("c", "k"), ("d", "d"), ("e", "je"), ("f", "f"), ("g", "ɡ"), ("h", "x"), ("i", "i"), ("j", "j"), ("k", "k"), ("l", "l"), ("m", "m"), ("n", "n"), ("o", "o"), ("p", "p"), ("q", "k"), ("r", "r"), ("s", "s"), ("t", "t"), ("u", "u"), ("v", "v"), ("w", "v"), ("x", "ks"), ("y", "ɨ"), ("z", "z"))


def t22(s, d):
    words = V.lexicon(s, d).where(F.col("word").rlike("^[a-z]+$"))
    return lexicon.transcribe(words, frame(s, SOUNDS, "c string, sound string"), {"e": "e"}, "bcdfgklmnpqrstvwxz")


T22 = f"""WITH {V.ctes('lexicon')}, lex AS (SELECT word FROM lexicon WHERE {has('word', '^[a-z]+$')}), c AS (SELECT word, i, substr(word, i, 1) AS c, CASE WHEN i > 1 THEN substr(word, i - 1, 1) ELSE '' END AS before FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM lex))
  SELECT word, string_agg(CASE WHEN c.c = 'e' AND {has('before', '[bcdfgklmnpqrstvwxz]')} THEN 'e' ELSE coalesce(sound, c.c) END, '' ORDER BY i) AS sounds FROM c LEFT JOIN {values(SOUNDS, 'letter, sound')} ON letter = c.c GROUP BY word"""


def t14(s, d):
    done = lexicon.translate_words(docs(s, d), frame(s, SHORT, "src string, dst string"), 0.0)
    return done.select("doc_id", (F.length("text") - F.col("n") + 1).cast("long").alias("chars"), F.col("n_found").alias("n"))


T14 = f'WITH {V.ctes("tokens")} SELECT doc_id, CAST(sum(length(coalesce(v."right", token))) AS BIGINT) AS chars, count(v."right") AS n FROM tokens LEFT JOIN {values(SHORT, chr(119) + "rong, " + chr(34) + "right" + chr(34))} ON lower(token) = wrong GROUP BY doc_id'


def t25(s, d):
    return V.captures(s, d).select("stream_id", "seq", T.time_text(F.lit(1704067200) + F.floor(F.col("t") / 1000)).alias("at"))


T25 = f"WITH {V.ctes('captures')} SELECT stream_id, seq, strftime(make_timestamp((1704067200 + t // 1000) * 1000000), '%Y-%m-%d %H:%M:%S') AS at FROM captures"


def t26(s, d):
    from captext.sources import files

    tree = F.expr("concat('{\"user\":{\"id\":', user_id, ',\"kind\":\"', event_type, '\"},\"props\":', props, ',\"on\":true}')")
    return V.table(s, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("k"), files.setting(tree, "user.kind", "default").alias("kind"), files.setting(tree, "user.missing.path", "default").alias("other"))


def t26_flatten(s, d):
    """The settings of each user as dotted paths, one of them set anew."""
    from captext.session import scratch
    from captext.sources import files

    tree = F.expr("concat('{\"user\":{\"id\":', user_id, ',\"kind\":\"', event_type, '\"},\"props\":', props, ',\"on\":true}')")
    rows = V.table(s, d, "events").select("event_id", tree.alias("tree"))
    # Read three times, so the trees are taken apart once and written to the shared folder.
    flat, path = files.flatten_settings(rows, "event_id", "tree"), scratch(s, "settings")
    flat.write.parquet(path)
    flat = s.read.schema(flat.schema).parquet(path)
    return files.set_setting(flat, "event_id", "user.kind", "set").union(flat.where("path = 'user.id'").select("event_id", F.lit("copy.id"), "value"))


T26F = """SELECT event_id, path, value FROM (SELECT event_id, 'user.id' AS path, CAST(user_id AS VARCHAR) AS value FROM events UNION ALL SELECT event_id, 'user.kind', 'set' FROM events UNION ALL SELECT event_id, concat('props.', unnest(json_keys(props))), CAST(json_extract_string(props, concat('$.', unnest(json_keys(props)))) AS VARCHAR) FROM events
  UNION ALL SELECT event_id, 'on', 'true' FROM events UNION ALL SELECT event_id, 'copy.id', CAST(user_id AS VARCHAR) FROM events)"""


def s4(s, d):
    """History written, added to and loaded: absent fields have their defaults."""
    from captext.sources import files

    rows = V.table(s, d, "conversations").select(F.expr("cast(conv_id * 3600 + turn AS double)").alias("timestamp"), F.when(F.col("turn") % 5 != 0, F.col("text")).alias("source_text"), "turn")
    path = files.new_history(s)
    files.append_history(rows.where("turn < 2").drop("turn"), path)
    files.append_history(rows.where("turn >= 2").withColumn("voice_preset", F.lit("v1")).drop("turn"), path)
    return files.load_history(s, path)


S4 = """SELECT CAST(conv_id * 3600 + turn AS DOUBLE) AS timestamp, CASE WHEN turn % 5 <> 0 THEN text ELSE '' END AS source_text, '' AS translated_text, '' AS source_lang, '' AS target_lang, '' AS ocr_text,
  CASE WHEN turn < 2 THEN '' ELSE 'v1' END AS voice_preset, '' AS image_path, strftime(make_timestamp((conv_id * 3600 + turn) * 1000000), '%Y-%m-%d %H:%M:%S') AS time_str FROM conversations"""


def s7(s, d):
    """Words written as compressed lists and read back."""
    from captext.sources import files

    path = files.new_history(s)
    V.tokens(s, d).select(F.concat(F.lit(" "), F.col("token"), F.lit("Ё "))).write.option("compression", "gzip").text(path)
    return files.read_word_list(s, path)


S7 = f"WITH {V.ctes('tokens')} SELECT DISTINCT translate(concat(lower(token), 'е'), 'ё', 'е') AS word FROM tokens"


def f8(s, d):
    return explode_lines(docs(s, d)).select("doc_id", "line_no", T.keep_script_words(F.col("line"), "à-ÿ").alias("value")).where("value IS NOT NULL")


#: Results of providers with the marks of those that failed or refused.
MARKED = "CASE WHEN rank = 2 AND doc_id % 3 = 0 THEN '[cannot do that]' ELSE result END"


def f12(s, d):
    rows = V.providers(s, d).withColumn("result", F.expr(MARKED)).withColumn("target", F.expr("CASE WHEN doc_id % 2 = 0 THEN 'ru' ELSE 'fr' END"))
    return rows.select("doc_id", "rank", T.failure_mark(F.col("result")).alias("mark"), F.coalesce(T.untranslated(F.col("result"), F.col("target")), F.lit(False)).alias("stray"))


F12 = f"WITH {V.ctes('providers')}, r AS (SELECT doc_id, rank, {MARKED} AS result FROM providers) SELECT doc_id, rank, CASE WHEN {has('result', r'^\s*\[.*failed.*\]\s*$')} THEN 'failed' WHEN {has('result', r'^\s*\[.*\]\s*$')} THEN 'refused' END AS mark, coalesce(doc_id % 2 = 0 AND {has('result', r'(^|[^A-Za-z])[a-z]{2,}($|[^A-Za-z])')}, false) AS stray FROM r"


def f14(s, d):
    return scoring.confidence_gates(V.boxes(s, d), "frame_id", "conf").select("frame_id", "n", F.round("mean", 6).alias("mean"))


#: Each line in Cyrillic letters but for its every fifth word.
MIXED = f"array_join(transform(split(line, ' '), (w, i) -> CASE WHEN i % 5 = 2 THEN w ELSE translate(lower(w), '{_ABC}', '{_CYR}') END), ' ')"


def t5(s, d):
    return explode_lines(docs(s, d)).select("doc_id", "line_no", T.strip_isolated_latin(F.expr(MIXED)).alias("value"))


T5 = f"""WITH {LINES}, m AS (SELECT doc_id, line_no, array_to_string(list_transform(string_split(line, ' '), lambda w, i: CASE WHEN i % 5 = 3 THEN w ELSE translate(lower(w), '{_ABC}', '{_CYR}') END), ' ') AS t FROM lines)
  SELECT doc_id, line_no, {sub(sub('t', r'([А-Яа-яЁё]) +[A-Za-z]{1,3}( +[А-Яа-яЁё])', r'\1\2'), r'([А-Яа-яЁё]) +[A-Za-z]{1,3}( +[А-Яа-яЁё])', r'\1\2')} AS value FROM m"""


def f16(s, d):
    e = scoring.frame_energy()
    scale = 0.95 / F.greatest(e["peak"], F.lit(1e-9))
    return vectors(s, d).where(e["peak"] >= 0.005).select("vec_id", F.round(e["rms"] * scale, 6).alias("rms"), (e["rms"] >= 0.01).alias("voice"))


F16 = f"SELECT vec_id, round({_RMS} * (CAST(0.95 AS DOUBLE) / greatest({_PEAK}, 1e-9)), 6) AS rms, {_RMS} >= 0.01 AS voice FROM embeddings WHERE {_PEAK} >= 0.005"

QUERIES = {
    "t5_isolated_latin": (t5, T5),
    "f16_audio_gates": (f16, F16),
    "t27_decide": (t27, _t27()),
    "a1_batch_summary": (a1, A1),
    "s2_batch_files": (s2, "SELECT page_id, length(html) AS chars, len(string_split(html, chr(10))) AS lines FROM pages"),
    "a2_keyword_emotion": (a2, A2),
    "a3_priority_emotion": (a3, f"WITH {LINES} SELECT doc_id, line_no, {EMOTION} AS emotion FROM lines"),
    "a4_situations": (a4, A4),
    "a5_preferences": (a5, A5),
    "a5_best_voices": (lambda s, d: scoring.best_voices(a5(s, d)), A5B),
    "a9_best_pass": (a9, A9),
    "a10_latest_by_region": (a10, A10),
    "a11_provider_health": (a11, A11),
    "a12_energy": (a12, A12),
    "a13_spectrum": (a13, A13),
    "a14_pitch": (a14, A14),
    "a15_voice_class": (a15, A15),
    "a16_otsu": (a16, A16),
    "a17_stretch": (a17, A17),
    "a18_frame_class": (a18, A18),
    "f8_keep_script_lines": (f8, f"WITH {LINES} SELECT doc_id, line_no, array_to_string(list_filter({WORDS('line')}, lambda w: {has('w', '[^A-Za-z]')}), ' ') AS value FROM lines WHERE {has('line', '[à-ÿ]')}"),
    "f11_speech_audit": (f11, F11),
    "f12_result_marks": (f12, F12),
    "f13_translation_quality": (f13, F13),
    "f14_confidence": (f14, f"WITH {V.ctes('boxes')} SELECT frame_id, count(*) AS n, round(avg(conf), 6) AS mean FROM boxes WHERE conf >= 40 GROUP BY frame_id HAVING avg(conf) >= 30"),
    "f15_history_search": (f15, F15),
    "f17_blur": (f17, F17),
    "s4_history_load": (s4, S4),
    "s7_word_list": (s7, S7),
    "t14_contractions": (t14, T14),
    "t16_chunks": (t16, T16),
    "t19_spoken_form": (t19, _t19()),
    "t21_prosody": (t21, T21),
    "t22_sounds": (t22, T22),
    "t25_time_text": (t25, T25),
    "t26_json_path": (t26, "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, event_type AS kind, 'default' AS other FROM events"),
    "t26_flatten": (t26_flatten, T26F),
    "t21_segments": (t21_segments, T21S),
    "a5_pick_voice": (a5_pick, A5P),
    "a14_yin": (a14_yin, A14Y),
    "a14_combined": (a14_combined, A14C),
    "a14_steadied": (a14_steadied, A14S),
    "a19_overlap": (lambda s, d: fusion.shown_overlaps(V.captures(s, d), V.subtitles(s, d)).withColumn("overlap", F.round("overlap", 6)), f"WITH {V.ctes('captures', 'subtitles')} SELECT c.stream_id, c.seq, u.seq AS n, round(CAST({OVERLAP('u.text', 'c.text')} AS DOUBLE), 6) AS overlap FROM captures c JOIN subtitles u ON c.stream_id = u.stream_id AND u.t BETWEEN c.t - 8000 AND c.t + 8000"),
}

