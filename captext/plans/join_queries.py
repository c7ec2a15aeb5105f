"""Queries over lexicon joins, interval and as-of joins and set operations, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captext.functions import text as T
from captext.operators import fusion, lexicon, reports
from captext.plans import views as V
from captext.plans.text_queries import has, q

GLOSSARY = (("the", "le"), ("of", "de"), ("and", "et"), ("to", "a"), ("in", "en"), ("is", "est"), ("that", "que"), ("for", "pour"), ("on", "sur"), ("with", "avec"), ("was", "etait"), ("by", "par"), ("this", "ce"), ("are", "sont"), ("be", "etre"), ("at", "chez"), ("or", "ou"), ("it", "il"), ("as", "comme"), ("der", "le"), ("die", "la"), ("und", "et"))
FIXES = (("thnt", "tent"), ("ndwh", "and"), ("aea", "area"), ("heer", "here"), ("reed", "read"), ("haing", "having"), ("erre", "error"), ("wh", "why"))
PHRASES = (("of the", "du"), ("in the", "dans le"), ("to the", "au"), ("and the", "et le"), ("on the", "sur le"), ("that the", "que le"), ("the of", "le de"), ("de la", "of the"), ("in der", "in the"))
EXTRA = (("the", "THE2"), ("cat", "chat"), ("dog", "chien"), ("of", "OF2"))
PROFILES = (("user", "en", "male", "v1"), ("assistant", "en", "female", "v2"))
DEFAULTS = (("en", "voice_en"), ("de", "voice_de"))
GENDERED = (("en", "male", "em"), ("de", "male", "dm"), ("de", "female", "df"), ("ru", "male", "rm"))
ALTERNATES = (("ru", "male", 0, "gone"), ("ru", "male", 1, "r2"), ("ru", "female", 0, "r3"), ("en", "female", 0, "e3"))
AVAILABLE = (("em",), ("df",), ("r2",), ("r3",))
WORDS_EN_FR = (("of", "de"), ("in", "dans"), ("to", "a"), ("and", "et"), ("is", "est"), ("that", "que"))
LONG_PHRASES = (("of the", "du"), ("in the", "dans le"), ("to the", "au"), ("and the", "et le"), ("the and the", "le et le"), ("on the", "sur le"), ("that the in", "que dans"), ("and that", "et ca"), ("that it", "ca"), ("von", "de la part"))
SPELLED = {"that's": "that is", "it's": "it is", "don't": "do not"}
COMPOUNDS = {"the and": "the-and", "Of the": "Of-the", "and and": "and-and"}
REGIONS = (("menu", 0, 0.0, 0.0, 120.0, 30.0), ("dialog", 1, 0.0, 40.0, 700.0, 60.0), ("tiny", 2, 10.0, 10.0, 20.0, 8.0), ("side", 3, 320.0, 0.0, 200.0, 200.0))


def values(rows, names: str) -> str:
    cell = lambda v: q(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


def frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def j1_word_translate(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.translate_words(V.table(spark, d, "documents"), frame(spark, GLOSSARY, "src string, dst string"))


J1 = f"""WITH {V.ctes('tokens')}, g AS (SELECT * FROM {values(GLOSSARY, 'src, dst')}), j AS (SELECT doc_id, pos, token, dst FROM tokens LEFT JOIN g ON lower(token) = src),
  a AS (SELECT doc_id, count(*) AS n, count(dst) AS n_found, string_agg(coalesce(dst, token), ' ' ORDER BY pos) AS text FROM j GROUP BY doc_id) SELECT doc_id, n, n_found, CASE WHEN n_found >= n * 0.3 THEN text ELSE '' END AS text FROM a"""


def j3_corrections(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.correct_tokens(V.tokens(spark, d), frame(spark, FIXES, "wrong string, right string")).where("fixed <> token").select("doc_id", "pos", "token", "fixed")


J3 = f"WITH {V.ctes('tokens')} SELECT doc_id, pos, token, v.\"right\" AS fixed FROM tokens JOIN {values(FIXES, 'wrong, \"right\"')} ON lower(token) = wrong WHERE v.\"right\" <> token"


def j3_fix_text(spark: SparkSession, d: str) -> DataFrame:
    from captext.operators.lines import explode_lines

    return explode_lines(V.table(spark, d, "documents")).select("doc_id", "line_no", T.fix_words(F.col("line"), dict(FIXES), COMPOUNDS).alias("value"))


def _j3_fix_text() -> str:
    from captext.plans.text_queries import LINES

    c = "line"
    for wrong, right in sorted(COMPOUNDS.items(), key=lambda x: (-len(x[0]), x[0])):
        c = f"replace({c}, {q(wrong)}, {q(right)})"
    cased = lambda put: f"CASE WHEN length(w) > 1 AND upper(w) = w THEN upper({q(put)}) WHEN substr(w, 1, 1) <> lower(substr(w, 1, 1)) THEN {q(put[0].upper() + put[1:])} ELSE {q(put)} END"
    fix = "CASE lower(w) " + " ".join(f"WHEN {q(a)} THEN {cased(b)}" for a, b in FIXES) + " ELSE w END"
    return f"WITH {LINES} SELECT doc_id, line_no, array_to_string(list_transform(regexp_extract_all({c}, '([A-Za-z]+|[^A-Za-z]+)'), lambda w: {fix}), '') AS value FROM lines"


def j2_phrase_translate(spark: SparkSession, d: str) -> DataFrame:
    from captext.operators.lines import explode_lines

    pairs = "src string, dst string"
    return lexicon.translate_phrases(explode_lines(V.table(spark, d, "documents")), frame(spark, LONG_PHRASES, pairs), frame(spark, WORDS_EN_FR, pairs), ["doc_id", "line_no"], contractions=SPELLED)


def _j2_translate() -> str:
    from captext.plans.text_queries import LINES, sub

    words = lambda c: f"list_filter(string_split_regex({c}, '[ \\t\\n]+'), lambda w: w <> '')"
    bare = words(sub("lower(line)", r"[^\p{L}\p{N}'\s]+", " "))
    spelled = "CASE w " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in SPELLED.items()) + " ELSE w END"
    made = words(f"array_to_string(list_transform({bare}, lambda w: replace({spelled}, chr(39), '')), ' ')")
    return f"""WITH RECURSIVE {LINES}, p AS (SELECT src, dst, len(string_split(src, ' ')) AS n FROM {values(LONG_PHRASES, 'src, dst')}), g AS (SELECT * FROM {values(WORDS_EN_FR, 'src, dst')}),
      w AS (SELECT doc_id, line_no, {made} AS w FROM lines), grams AS (SELECT doc_id, line_no, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w), range(1, 7) r(n) WHERE i + n - 1 <= len(w)),
      hits AS (SELECT doc_id, line_no, i, max(struct_pack(n := p.n, dst := p.dst)) AS h FROM grams JOIN p ON gram = src AND grams.n = p.n WHERE p.n > 1 GROUP BY ALL),
      steps AS (SELECT grams.doc_id, grams.line_no, grams.i, coalesce(h.n, 1) AS n, CASE WHEN h.n > 1 THEN h.dst WHEN g.dst IS NOT NULL THEN g.dst WHEN gram IN ('a', 'an', 'the') THEN '' ELSE gram END AS put
        FROM grams LEFT JOIN hits ON hits.doc_id = grams.doc_id AND hits.line_no = grams.line_no AND hits.i = grams.i LEFT JOIN g ON gram = g.src WHERE grams.n = 1),
      walk AS (SELECT doc_id, line_no, CAST(1 AS BIGINT) AS place FROM w WHERE len(w) > 0 UNION ALL SELECT walk.doc_id, walk.line_no, place + steps.n FROM walk JOIN steps ON steps.doc_id = walk.doc_id AND steps.line_no = walk.line_no AND steps.i = place),
      said AS (SELECT steps.doc_id, steps.line_no, string_agg(put, ' ' ORDER BY steps.i) FILTER (WHERE put <> '') AS text FROM walk JOIN steps ON steps.doc_id = walk.doc_id AND steps.line_no = walk.line_no AND steps.i = place GROUP BY ALL)
      SELECT w.doc_id, w.line_no, coalesce(p.dst, said.text, '') AS text FROM w LEFT JOIN said ON said.doc_id = w.doc_id AND said.line_no = w.line_no LEFT JOIN p ON array_to_string(w, ' ') = p.src WHERE len(w) > 0"""


def j2_phrases(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.phrase_hits_in_texts(V.table(spark, d, "documents"), frame(spark, PHRASES, "src string, dst string"))


J2 = f"""WITH {V.ctes('tokens')}, p AS (SELECT doc_id, pos, concat(lower(token), ' ', lower(lead(token) OVER (PARTITION BY doc_id ORDER BY pos))) AS src FROM tokens),
  h AS (SELECT doc_id, pos, src, dst, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM p JOIN {values(PHRASES, 's, dst')} ON src = s),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) AS nth FROM h) SELECT doc_id, pos, src, dst FROM r WHERE nth % 2 = 1"""


def j4_memory(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "documents").select("doc_id", "lang", F.trim("text").alias("key"))
    memory = rows.where("doc_id % 2 = 0").select("lang", "key").distinct().withColumn("hit", F.lit(1))
    return fusion.memory_lookup(rows, memory, ["lang", "key"]).groupBy("lang").agg(F.count("*").alias("n"), F.count("hit").alias("n_hits"), F.count_distinct(F.when(F.col("hit").isNull(), F.col("key"))).alias("n_misses"))


J4 = """WITH r AS (SELECT doc_id, lang, trim(text) AS key FROM documents), m AS (SELECT DISTINCT lang, key, 1 AS hit FROM r WHERE doc_id % 2 = 0)
  SELECT r.lang, count(*) AS n, count(hit) AS n_hits, count(DISTINCT CASE WHEN hit IS NULL THEN r.key END) AS n_misses FROM r LEFT JOIN m ON r.lang = m.lang AND r.key = m.key GROUP BY r.lang"""


def unknown_words(spark: SparkSession, d: str, least: int = 4) -> DataFrame:
    return V.tokens(spark, d).select(F.lower("token").alias("word")).where(F.col("word").rlike(rf"^\p{{L}}{{{least},}}$")).distinct()


def j5_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.fuzzy_lexicon(unknown_words(spark, d), V.lexicon(spark, d), 2)


#: DuckDB measures distances in bytes: each accented letter as one other byte.
_BYTES = lambda w: f"translate({w}, 'àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœß', '0123456789!#$%&()*+,-./:;<=>?@[]^')"
#: A word and what is left of it after one or two letters go.
_LEFT = lambda w: f"list_distinct(list_concat([{w}], flatten(list_transform(range(1, length({w}) + 1), lambda i: list_concat([concat(substr({w}, 1, i - 1), substr({w}, i + 1))], list_transform(range(i + 1, length({w}) + 1), lambda j: concat(substr({w}, 1, i - 1), substr({w}, i + 1, j - i - 1), substr({w}, j + 1))))))))"
J5 = f"""WITH {V.ctes('lexicon')}, u AS (SELECT DISTINCT lower(token) AS word FROM tokens WHERE {has('lower(token)', '^\\p{L}{4,}$')} AND lower(token) NOT IN (SELECT word FROM lexicon)),
  a AS (SELECT word, unnest({_LEFT('word')}) AS part FROM u), b AS (SELECT word AS best, freq, unnest({_LEFT('word')}) AS part FROM lexicon),
  m AS (SELECT DISTINCT a.word, b.best, b.freq FROM a JOIN b ON a.part = b.part WHERE abs(length(a.word) - length(b.best)) <= 2), p AS (SELECT word, best, freq, levenshtein({_BYTES('word')}, {_BYTES('best')}) AS dist FROM m)
  SELECT word, best, CAST(dist AS INTEGER) AS dist FROM p WHERE dist <= 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY dist, freq DESC, best) = 1"""


def j5_spelling(spark: SparkSession, d: str) -> DataFrame:
    """The documents with their unknown words corrected, case kept."""
    return lexicon.correct_spelling(V.table(spark, d, "documents").select("doc_id", "text"), V.lexicon(spark, d, 20).where("length(word) > 2"))


def j6_confusion(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.confusion_correct(unknown_words(spark, d), V.lexicon(spark, d))


_MATES = values(tuple(lexicon._mates().items()), "letter, mates")
J6 = f"""WITH {V.ctes('lexicon')}, u AS (SELECT DISTINCT lower(token) AS word FROM tokens WHERE {has('lower(token)', '^\\p{L}{4,}$')} AND lower(token) NOT IN (SELECT word FROM lexicon)),
  p AS (SELECT word, i, substr(word, i, 1) AS c, substr(word, i + 1, 1) AS next FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM u)),
  m AS (SELECT word, i, c, next, mates, unnest(string_split(mates, '')) AS mate FROM p JOIN {_MATES} ON c = letter),
  cand AS (SELECT word, concat(substr(word, 1, i - 1), mate, substr(word, i + 1)) AS candidate, 2 AS weight FROM m
    UNION ALL SELECT word, concat(substr(word, 1, i), mate, substr(word, i + 1)), 1 FROM m
    UNION ALL SELECT word, concat(substr(word, 1, i - 1), substr(word, i + 1)), CASE WHEN next <> '' AND contains(coalesce(mates, ''), next) THEN 2 ELSE 0 END FROM p LEFT JOIN {_MATES} ON c = letter),
  best AS (SELECT word, candidate, max(weight) AS weight FROM cand GROUP BY word, candidate),
  r AS (SELECT best.word, candidate, rank() OVER (PARTITION BY best.word ORDER BY weight DESC, freq DESC) AS r FROM best JOIN lexicon ON candidate = lexicon.word)
  SELECT word, min(candidate) AS best FROM r WHERE r = 1 GROUP BY word HAVING count(*) = 1"""


def j7_split_glued(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.split_glued(unknown_words(spark, d, 6), V.lexicon(spark, d))


def j8_longest_match(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.longest_match(unknown_words(spark, d, 1), V.lexicon(spark, d))


J8 = f"""WITH RECURSIVE {V.ctes('tokens')}, lex AS (SELECT lower(token) AS piece FROM tokens WHERE {has('token', '^\\p{L}+$')} GROUP BY 1 HAVING count(*) >= 3),
  u AS (SELECT DISTINCT lower(token) AS word FROM tokens WHERE {has('lower(token)', '^\\p{L}+$')}),
  parts AS (SELECT word, i, n FROM (SELECT word, i, unnest(range(1, CAST(least(20, length(word) - i + 1) + 1 AS BIGINT))) AS n FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM u)) WHERE substr(word, i, n) IN (SELECT piece FROM lex)),
  far AS (SELECT word, i, max(n) AS n FROM parts GROUP BY word, i),
  walk AS (SELECT word, CAST(1 AS BIGINT) AS place, '' AS text FROM u UNION ALL
    SELECT w.word, w.place + coalesce(f.n, 1), concat(w.text, CASE WHEN w.place > 1 THEN ' ' ELSE '' END, substr(w.word, w.place, coalesce(f.n, 1))) FROM walk w LEFT JOIN far f ON f.word = w.word AND f.i = w.place WHERE w.place <= length(w.word))
  SELECT word, text AS parts FROM walk WHERE place > length(word)"""


def j9_regions(spark: SparkSession, d: str) -> DataFrame:
    regions = frame(spark, REGIONS, "name string, ord int, x double, y double, w double, h double").where("w > 30 AND h > 12")
    return fusion.boxes_in_regions(V.boxes(spark, d), regions).groupBy("frame_id", "name").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


J9 = f"""WITH {V.ctes('boxes')} SELECT frame_id, name, count(*) AS n, min(pos) AS first_pos FROM boxes JOIN {values(REGIONS, 'name, ord, x, y, w, h')} ON x0 >= x AND x1 <= x + w AND y0 >= y AND y1 <= y + h
  WHERE w > 30 AND h > 12 GROUP BY frame_id, name"""


def j9_screen_bands(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of an area at (100, 50), scaled by two, in the lower bands of regions on the screen."""
    regions = frame(spark, [(n, x + 100, y + 50, w, h) for n, _, x, y, w, h in REGIONS], "name string, x double, y double, w double, h double")
    met = fusion.boxes_in_regions(fusion.to_screen(V.boxes(spark, d), 100.0, 50.0, 2.0), fusion.sub_band(regions, 0.4, 1.0))
    return met.groupBy("frame_id", "name").agg(F.count("*").alias("n"))


J9B = f"""WITH {V.ctes('boxes')}, r AS (SELECT name, x + 100 AS x, y + 50 + least(h * 0.4, h - least(h, greatest(12.0, h * (1.0 - 0.4)))) AS y, w, least(h, greatest(12.0, h * (1.0 - 0.4))) AS h FROM {values(REGIONS, 'name, ord, x, y, w, h')})
  SELECT frame_id, name, count(*) AS n FROM boxes JOIN r ON 100 + x0 / 2 >= x AND 100 + x1 / 2 <= x + w AND 50 + y0 / 2 >= y AND 50 + y1 / 2 <= y + h GROUP BY frame_id, name"""
_SET = lambda c: f"list_distinct(regexp_extract_all(lower({c}), {q('([\\p{L}\\p{N}_]+)')}))"
OVERLAP = lambda a, b: f"CASE WHEN len({_SET(a)}) > 0 AND len({_SET(b)}) > 0 THEN len(list_intersect({_SET(a)}, {_SET(b)})) / greatest(len({_SET(a)}), len({_SET(b)})) ELSE 0.0 END"


def j10_fusion(spark: SparkSession, d: str) -> DataFrame:
    out = fusion.fuse_subtitles(V.speech(spark, d), V.subtitles(spark, d))
    return out.select("stream_id", "seq", "fused", F.round("overlap", 6).alias("overlap"), "text")


J10 = f"""WITH {V.ctes('subtitles')}, j AS (SELECT s.stream_id, s.seq, s.text AS spoken, u.text AS shown, row_number() OVER (PARTITION BY s.stream_id, s.seq ORDER BY u.t DESC NULLS LAST, u.seq DESC NULLS LAST) AS r
  FROM speech s LEFT JOIN subtitles u ON u.stream_id = s.stream_id AND u.t <= s.t1 AND u.t >= s.t1 - 8000),
  o AS (SELECT *, {OVERLAP("coalesce(shown, '')", 'spoken')} AS overlap FROM j WHERE r = 1)
  SELECT stream_id, seq, overlap >= 0.34 AS fused, round(CAST(overlap AS DOUBLE), 6) AS overlap, CASE WHEN overlap >= 0.34 THEN shown ELSE spoken END AS text FROM o"""


def j11_silent(spark: SparkSession, d: str) -> DataFrame:
    return fusion.silent_subtitles(V.subtitles(spark, d), V.speech(spark, d)).select("stream_id", "t", "text", "seq")


J11 = f"WITH {V.ctes('subtitles')} SELECT stream_id, t, text, seq FROM subtitles u WHERE NOT EXISTS (SELECT 1 FROM speech s WHERE s.stream_id = u.stream_id AND s.t0 <= u.t AND s.t1 >= u.t - 2500)"


def j12_echo(spark: SparkSession, d: str) -> DataFrame:
    return fusion.without_echo(V.speech(spark, d), V.playback(spark, d)).select("stream_id", "seq", "t0", "t1")


J12 = f"WITH {V.ctes('speech', 'playback')} SELECT stream_id, seq, t0, t1 FROM speech s WHERE NOT EXISTS (SELECT 1 FROM playback p WHERE p.stream_id = s.stream_id AND s.t0 < p.t1 + 2500 AND s.t1 > p.t0)"


def j13_near_lines(spark: SparkSession, d: str) -> DataFrame:
    from captext.operators.lines import explode_lines

    lines = explode_lines(V.table(spark, d, "documents")).select("line").distinct()
    return fusion.similar_texts(lines, "line", 0.75)


def j13_groups(spark: SparkSession, d: str) -> DataFrame:
    from captext.operators.lines import explode_lines

    lines = explode_lines(V.table(spark, d, "documents")).select("line").distinct()
    return fusion.similar_groups(lines, "line", 0.75)


def j13_contained(spark: SparkSession, d: str) -> DataFrame:
    from captext.operators.lines import explode_lines

    lines = explode_lines(V.table(spark, d, "documents")).select("line").distinct()
    return fusion.contained_texts(lines, "line", 8)


def j14_voices(spark: SparkSession, d: str) -> DataFrame:
    people = V.table(spark, d, "conversations").groupBy("conv_id", "role").count().withColumn("lang", F.expr("CASE conv_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'ru' END")).withColumn("gender", F.expr("CASE WHEN conv_id % 2 = 0 THEN 'male' ELSE 'female' END"))
    gendered, profiles = "lang string, gender string, voice string", "role string, lang string, gender string, voice string"
    out = fusion.route_voices(people, frame(spark, PROFILES[:1], profiles), frame(spark, GENDERED, gendered), frame(spark, ALTERNATES, "lang string, gender string, ord int, voice string"), frame(spark, AVAILABLE, "voice string"))
    return out.select("conv_id", "role", "lang", "gender", "voice", "how")


J14 = f"""WITH p AS (SELECT DISTINCT conv_id, role, CASE conv_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'ru' END AS lang, CASE WHEN conv_id % 2 = 0 THEN 'male' ELSE 'female' END AS gender FROM conversations), h AS (SELECT * FROM {values(AVAILABLE, 'have')}),
  x AS (SELECT lang, gender, voice FROM {values(ALTERNATES, 'lang, gender, ord, voice')} WHERE voice IN (SELECT have FROM h) QUALIFY row_number() OVER (PARTITION BY lang, gender ORDER BY ord) = 1), b AS (SELECT * FROM {values(GENDERED, 'lang, gender, voice')} WHERE voice IN (SELECT have FROM h))
  SELECT conv_id, p.role, p.lang, p.gender, coalesce(a.voice, b.voice, x.voice, 'voice_any') AS voice, CASE WHEN a.voice IS NOT NULL THEN 'speaker' WHEN b.voice IS NOT NULL THEN 'language' WHEN x.voice IS NOT NULL THEN 'alternate' ELSE 'default' END AS how
  FROM p LEFT JOIN (SELECT * FROM {values(PROFILES[:1], 'role, lang, gender, voice')}) a ON a.role = p.role AND a.lang = p.lang LEFT JOIN b ON b.lang = p.lang AND b.gender = p.gender LEFT JOIN x ON x.lang = p.lang AND x.gender = p.gender"""


def j15_language_route(spark: SparkSession, d: str) -> DataFrame:
    routed = reports.language_routes(V.table(spark, d, "documents").select("doc_id", "text"), frame(spark, DEFAULTS, "lang string, voice string"))
    return routed.groupBy("lang", "voice").agg(F.count("*").alias("n"))


def _j15() -> str:
    from captext.plans.text_queries import DETECT

    return f"SELECT r.lang, coalesce(voice, 'voice_any') AS voice, count(*) AS n FROM (SELECT {DETECT} AS lang FROM documents) r LEFT JOIN (SELECT * FROM {values(DEFAULTS, 'l, voice')}) ON l = r.lang GROUP BY 1, 2"


def j16_diff(spark: SparkSession, d: str) -> DataFrame:
    return fusion.snapshot_diff(V.settings(spark, d, "<= 20"), V.settings(spark, d, ">= 11"))


J16 = f"""WITH {V.ctes('settings_a', 'settings_b')} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS kind, a.value AS old, b.value AS new
  FROM settings_a a FULL JOIN settings_b b ON a.path = b.path WHERE a.value IS DISTINCT FROM b.value"""


def j17_merge(spark: SparkSession, d: str) -> DataFrame:
    return fusion.snapshot_merge(V.settings(spark, d, "<= 20"), V.settings(spark, d, ">= 11"))


J17 = f"WITH {V.ctes('settings_a', 'settings_b')} SELECT coalesce(a.path, b.path) AS path, coalesce(b.value, a.value) AS value FROM settings_a a FULL JOIN settings_b b ON a.path = b.path"


def j18_coverage(spark: SparkSession, d: str) -> DataFrame:
    return reports.uncovered(V.lexicon(spark, d, 20), frame(spark, GLOSSARY, "src string, dst string"))


J18 = f"WITH {V.ctes('tokens')} SELECT lower(token) AS word, count(*) AS freq FROM tokens WHERE {has('token', '^\\p{L}+$')} AND lower(token) NOT IN (SELECT src FROM {values(GLOSSARY, 'src, dst')}) GROUP BY 1 HAVING count(*) >= 20"


def u1_dictionaries(spark: SparkSession, d: str) -> DataFrame:
    known = lexicon.lexicon_union(frame(spark, GLOSSARY, "src string, dst string"), frame(spark, EXTRA, "src string, dst string"))
    return V.lexicon(spark, d).join(known, F.col("word") == F.col("src")).select("src", "dst", "freq")


U1 = f"""WITH {V.ctes('lexicon')}, k AS (SELECT src, dst, 0 AS p FROM {values(GLOSSARY, 'src, dst')} UNION ALL SELECT src, dst, 1 FROM {values(EXTRA, 'src, dst')}), o AS (SELECT src, dst FROM k QUALIFY row_number() OVER (PARTITION BY src ORDER BY p) = 1)
  SELECT src, dst, freq FROM lexicon JOIN o ON word = src"""

QUERIES = {
    "a8_lexicon": (lambda s, d: V.lexicon(s, d), f"WITH {V.ctes('lexicon')} SELECT word, freq FROM lexicon"),
    "j1_word_translate": (j1_word_translate, J1),
    "j2_phrases": (j2_phrases, J2),
    "j2_phrase_translate": (j2_phrase_translate, _j2_translate()),
    "j3_fix_text": (j3_fix_text, _j3_fix_text()),
    "j5_spelling": (j5_spelling, None),
    "j3_corrections": (j3_corrections, J3),
    "j4_memory": (j4_memory, J4),
    "j5_fuzzy": (j5_fuzzy, J5),
    "j6_confusion": (j6_confusion, J6),
    "j7_split_glued": (j7_split_glued, None),
    "j8_longest_match": (j8_longest_match, J8),
    "j9_regions": (j9_regions, J9),
    "j9_screen_bands": (j9_screen_bands, J9B),
    "j10_fusion": (j10_fusion, J10),
    "j11_silent": (j11_silent, J11),
    "j12_echo": (j12_echo, J12),
    "j13_near_lines": (j13_near_lines, None),
    "j13_contained": (j13_contained, None),
    "j13_groups": (j13_groups, None),
    "j14_voices": (j14_voices, J14),
    "j15_language_route": (j15_language_route, _j15()),
    "j16_diff": (j16_diff, J16),
    "j17_merge": (j17_merge, J17),
    "j18_coverage": (j18_coverage, J18),
    "u1_dictionaries": (u1_dictionaries, U1),
}
