"""Queries over scalar text functions and line filters, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captext.functions import text as T
from captext.operators.cleaning import CAPTION, clean_documents, clean_stages, stage_audit
from captext.operators.lexicon import build_lexicon
from captext.operators.lines import explode_lines, explode_tokens

LINES = """lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, trim(x) AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(x) <> '')"""
TOKENS = """tokens AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, x AS token FROM (
  SELECT doc_id, unnest(string_split_regex(text, '[ \\n]+')) AS x, generate_subscripts(string_split_regex(text, '[ \\n]+'), 1) AS i FROM documents) WHERE x <> '')"""


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def n(column: str, pattern: str) -> str:
    """SQL for the number of matches."""
    return f"len(regexp_extract_all({column}, {q(pattern)}))"


def sub(column: str, pattern: str, to: str) -> str:
    return f"regexp_replace({column}, {q(pattern)}, {q(to)}, 'g')"


def has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return explode_lines(docs(spark, d))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return explode_tokens(docs(spark, d))


WORDS = lambda c: f"list_filter(string_split_regex({c}, '[ \\t\\n]+'), lambda w: w <> '')"
KEY = lambda c: f"trim({sub(sub(f'lower({c})', r'[^\p{L}\p{N}\s]+', ' '), r'\s+', ' ')})"


def per_doc(column, sql: str):
    """A query of one value per document, compared as a whole."""
    return (lambda spark, d: docs(spark, d).select("doc_id", column(F.col("text")).alias("value"))), f"SELECT doc_id, {sql} AS value FROM documents"


def per_line(column, sql: str):
    return (lambda spark, d: lines(spark, d).select("doc_id", "line_no", column(F.col("line")).alias("value"))), f"WITH {LINES} SELECT doc_id, line_no, {sql} AS value FROM lines"


def line_filter(column, sql: str):
    return (lambda spark, d: lines(spark, d).where(column(F.col("line")))), f"WITH {LINES} SELECT doc_id, line_no, line FROM lines WHERE {sql}"


def hyphenated(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a hyphen and a line break inside every seventh word of six letters or more."""
    broken = F.expr(r"array_join(transform(split(text, ' '), (w, i) -> CASE WHEN i % 7 = 6 AND length(w) >= 6 THEN concat(substr(w, 1, 3), '-\n', substr(w, 4)) ELSE w END), ' ')")
    return docs(spark, d).select("doc_id", broken.alias("text"))


HYPHENATED = r"""hyphenated AS (SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN (i - 1) % 7 = 6 AND length(w) >= 6 THEN concat(substr(w, 1, 3), '-', chr(10), substr(w, 4)) ELSE w END), ' ') AS text FROM documents)"""
#: The letters of every fifth word or so drawn like Cyrillic ones, marks without sense, zeros after a fraction, and a ramp of letters.
DIRT = "CASE WHEN i % 11 = 5 THEN translate(w, 'aeopcxy', 'аеорсху') WHEN i % 13 = 7 THEN concat(w, ' ~~§ ') WHEN i % 17 = 3 THEN concat(w, ' 1.500 thnt') WHEN i % 97 = 50 THEN concat(w, ' abcdefghijklm') WHEN i % 7 = 6 AND length(w) >= 6 THEN concat(substr(w, 1, 3), '-', chr(10), substr(w, 4)) ELSE w END"


def dirty(spark: SparkSession, d: str) -> DataFrame:
    """Documents with homoglyphs, broken words, noise, decimals and ramps put in."""
    return docs(spark, d).select("doc_id", T.Plain(_dirt)(F.col("text")).alias("text"))


def _dirt():
    """DIRT of a text's words, as a function: of the words at a place of several kinds the first kind in DIRT counts."""
    cyrillic = str.maketrans("aeopcxy", "аеорсху")
    kinds = (
        (6, 7, lambda w: f"{w[:3]}-\n{w[3:]}" if len(w) >= 6 else w), (50, 97, lambda w: f"{w} abcdefghijklm"), (3, 17, lambda w: f"{w} 1.500 thnt"), (7, 13, lambda w: f"{w} ~~§ "), (5, 11, lambda w: w.translate(cyrillic)),
    )

    def change(t: str) -> str:
        words = t.split(" ")
        out = words.copy()
        for first, step, put in kinds:
            out[first::step] = map(put, words[first::step])
        return " ".join(out)

    return change


DIRTY = f"dirty AS (SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w, j: {DIRT.replace('i %', '(j - 1) %')}), ' ') AS text FROM documents)"
_ABC, _CYR = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстуввхыз"
#: Tokens of four Latin letters or more, by turns with letters drawn like Cyrillic ones, glued to their Cyrillic spelling, and in Ukrainian letters.
RAW = f"CASE (doc_id + pos) % 3 WHEN 0 THEN translate(token, 'aeopcxy', 'аеорсху') WHEN 1 THEN concat(token, translate(lower(token), '{_ABC}', '{_CYR}')) ELSE translate(lower(token), '{_ABC}', '{_CYR.replace('и', 'і')}') END"
NOISY = f"noisy AS (SELECT doc_id, pos, token, {RAW} AS raw FROM tokens WHERE {has('token', '^[A-Za-z]{4,}$')})"


def noisy(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).where(F.col("token").rlike("^[A-Za-z]{4,}$")).withColumn("raw", F.expr(RAW)).select("doc_id", "pos", "token", "raw")


def repair_sql(c: str) -> str:
    """repair_homoglyphs of a SQL expression."""
    latin, cyrillic = n(c, T.LATIN), n(c, T.CYRILLIC_BLOCK)
    glued = sub(sub(c, T.GLUED[0], r"\1 \2"), T.GLUED[1], r"\1 \2")
    lead = f"(CASE WHEN {n(c, T.SURE_LATIN)} = 0 AND {n(c, T.SURE_CYRILLIC)} = 0 THEN {cyrillic} - {latin} ELSE {n(c, T.SURE_CYRILLIC)} - {n(c, T.SURE_LATIN)} END)"
    ukr = lambda x: f"translate({x}, {q(T.UKRAINIAN)}, {q(T.RUSSIAN)})"
    return (
        f"CASE WHEN NOT {has(c, T.CYRILLIC_BLOCK)} THEN {c} WHEN {glued} <> {c} THEN {ukr(glued)} WHEN {lead} > 0 THEN {ukr(f'translate({c}, {q(T.HOMOGLYPH_LATIN)}, {q(T.HOMOGLYPH_CYRILLIC)})')}"
        f" WHEN {lead} < 0 THEN translate({c}, {q(T.CYRILLIC_LOOKALIKE)}, {q(T.LATIN_LOOKALIKE)}) ELSE {c} END"
    )


VALID = (
    f"length(trim(line)) >= 3 AND NOT contains(line, chr(65533)) AND {n('line', r'\p{L}')} > 0 AND {n('line', r'\p{Nd}')} <= {n('line', r'\p{L}')} AND NOT {has('line', r'\d{4}[-/.]\d{2}[-/.]\d{2}')}"
    f" AND NOT {has('line', r'\d{1,2}:\d{2}')} AND {n('line', '[^\\p{L}\\p{N}\\s.,!?\\-:;\'\"()]')} <= {n('line', r'\p{L}')} * 0.4 AND len(list_filter({WORDS('line')}, lambda w: length(w) > 2)) > 0"
)


def _garbage_sql() -> str:
    letters, w = n("line", r"\p{L}"), WORDS("line")
    noisy_words = f"len(list_filter({w}, lambda x: {has('x', r'[~_{}\[\]\\]')} OR {n('x', r'[^\p{L}\p{N}_]')} > 1))"
    c, a = n("line", T.CYRILLIC), n("line", "[a-z]")
    return f"""CASE WHEN length(line) <= 2 THEN 'short' WHEN {letters} < 2 AND length(line) <= 5 THEN 'few_letters'
      WHEN {n('line', r'[|~`{}<>\[\]\\^_]')} > {letters} AND {letters} < 4 THEN 'junk' WHEN {has('line', r'[\x{3040}-\x{30FF}]')} THEN 'kana'
      WHEN {has('line', r'[\x{0600}-\x{06FF}]')} THEN 'arabic' WHEN {has('line', r'[\x{4E00}-\x{9FFF}]')} THEN 'han'
      WHEN {c} > 0 AND {a} > 0 AND {letters} >= 3 AND abs({c} - {a}) <= 2 THEN 'mixed' WHEN {has('line', T.CYRILLIC + r'\d' + T.CYRILLIC)} THEN 'digit_inside'
      WHEN {has('line', r'\d' + T.CYRILLIC + r'\d')} THEN 'letter_inside' WHEN {noisy_words} > 0 AND {noisy_words} >= len({w}) * 0.5 THEN 'noisy_words'
      WHEN {n('line', r'[\x{1F300}-\x{1FAFF}]')} > 0 AND {letters} < 3 THEN 'emoji' END"""


def _space_sql(c: str) -> str:
    for p, to in ((r"[ \t]+", " "), (r" *\n *", "\n"), (r"\.{4,}", "…"), (r"\.\.\.", "…"), (r"\s+([,.!?;:])", r"\1"), (r"([(\[«])\s+", r"\1")):
        c = sub(c, p, to)
    return f"trim({c})"


def _decimals_sql(c: str) -> str:
    return sub(sub(c, r"\b(\d+)\.0+\b", r"\1"), r"\b(\d+\.\d*[1-9])0+\b", r"\1")


def _log_sql(c: str) -> str:
    s = f"trim({c})"
    for p in (r"^\d{1,2}[-/]\d{1,2}\s+\d{1,2}:\d{2}(:\d{2})?[.,]?\d*\s*", r"^\d{1,2}:\d{2}(:\d{2})?[.,]?\d*\s*", r"^\[?(INFO|DEBUG|ERROR|WARNING|TRACE)\]?\s*", r"^[a-z_]+\s*-\s*", r"^[-\d]+\s*"):
        s = sub(s, p, "")
    return f"CASE WHEN NOT {has(c, T.CYRILLIC)} AND {has(s, '[A-Za-z]{2,}')} THEN trim({s}) END"


def _pauses_sql(c: str) -> str:
    for p, to in ((r"(\.\.\.|…)", r"\1<600>"), (r"([.!?])( |\n|$)", r"\1<500>\2"), (r"([;:])( |\n|$)", r"\1<300>\2"), (r"(,)( |\n|$)", r"\1<200>\2")):
        c = sub(c, p, to)
    return c


_VOTES = lambda known: f"len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w IN ({', '.join(map(q, known))})))"
DETECT = (
    f"CASE WHEN {has('text', T.CYRILLIC)} THEN 'ru' WHEN {has('text', r'[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]')} THEN 'ja' WHEN {has('text', '[äöüßÄÖÜ]')} THEN 'de'"
    f" WHEN {has('text', '[àâçéèêëïîôùûÿœæ]')} THEN 'fr' WHEN NOT {has('lower(text)', '[a-z]')} THEN 'auto' WHEN {_VOTES(T.RUSSIAN_IN_LATIN)} > {_VOTES(T.ENGLISH)} THEN 'ru' ELSE 'en' END"
)
SENTENCES = f"list_filter(list_transform(regexp_extract_all(text, {q(r'([^.!?…\n]+[.!?…]*)')}), lambda s: trim(s)), lambda s: s <> '')"


def a6_script_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = explode_lines(docs(spark, d), keep=("lang", "source")).where(T.is_valid_text(F.col("line")))
    return rows.groupBy("lang", "source").agg(
        F.count("*").alias("n_lines"), F.round(F.avg(T.script_share(F.col("line"), LATIN_CLASS)), 6).alias("latin"), F.round(F.avg(T.script_share(F.col("line"), T.CYRILLIC)), 6).alias("cyrillic"), F.sum(F.length(T.normalise_key(F.col("line")))).alias("key_chars")
    )


LATIN_CLASS = T.LATIN
A6 = f"""WITH {LINES} SELECT lang, source, count(*) AS n_lines, round(avg({n('line', T.LATIN)} / {n('line', r'\p{L}')}), 6) AS latin, round(avg({n('line', T.CYRILLIC)} / {n('line', r'\p{L}')}), 6) AS cyrillic,
  CAST(sum(length({KEY('line')})) AS BIGINT) AS key_chars FROM lines JOIN documents USING (doc_id) WHERE {VALID} GROUP BY lang, source"""


def a7_language_confusion(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["ru", "ja", "de", "fr", "en", "auto"]
    found = docs(spark, d).withColumn("found", T.detect_language(F.col("text"))).groupBy("lang").pivot("found", kinds).count()
    return found.select("lang", *(F.coalesce(k, F.lit(0)).alias(f"as_{k}") for k in kinds))


A7 = f"SELECT lang, {', '.join(f'count(*) FILTER (WHERE found = {q(k)}) AS as_{k}' for k in ('ru', 'ja', 'de', 'fr', 'en', 'auto'))} FROM (SELECT lang, {DETECT} AS found FROM documents) GROUP BY lang"


def a7_cyrillic_share(spark: SparkSession, d: str) -> DataFrame:
    """Every third line in Cyrillic spelling, some with a part of it only, by the share of their letters."""
    rows = explode_lines(docs(spark, d)).withColumn("text", F.expr(SPELT)).withColumn("found", T.main_script(F.col("text")))
    return rows.groupBy(F.expr("line_no % 6").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("found") == "ru").alias("as_ru"))


SPELT = f"CASE line_no % 6 WHEN 0 THEN translate(lower(line), '{_ABC}', '{_CYR}') WHEN 3 THEN concat(line, ' ', translate(substr(lower(line), 1, 12), '{_ABC}', '{_CYR}')) ELSE line END"
A7S = f"WITH {LINES}, t AS (SELECT line_no, {SPELT} AS text FROM lines) SELECT CAST(line_no % 6 AS INTEGER) AS kind, count(*) AS n, count(*) FILTER (WHERE {n('text', r'[\x{0400}-\x{04FF}]')} > {n('text', r'\p{L}')} * 0.3) AS as_ru FROM t GROUP BY 1"


#: Every 50th token followed by so many letters from its first one on.
RISEN = "CASE WHEN (doc_id + pos) % 50 = 0 THEN concat('AB', substr('abcdefghijklmnopqrstuvwxyz', 1, CAST(2 + pos % 20 AS INTEGER))) ELSE token END"


def f6_ramp_tokens(spark: SparkSession, d: str) -> DataFrame:
    found = tokens(spark, d).select(F.expr(RISEN).alias("token")).where(F.length("token") >= 8).groupBy("token").agg(F.count("*").alias("n"))
    return found.where(T.is_ramp(F.col("token"))).select("token", T.longest_ramp(F.col("token")).cast("long").alias("ramp"), "n")


F6 = f"""WITH {TOKENS}, vocabulary AS (SELECT token, count(*) AS n FROM (SELECT {RISEN} AS token FROM tokens) WHERE length(token) >= 8 GROUP BY token),
  runs AS (SELECT token, n, list_reduce(list_transform(string_split(token, ''), lambda c: {{'last': unicode(c), 'run': 1, 'best': 1}}),
    lambda s, c: {{'last': c.last, 'run': CASE WHEN c.last > s.last THEN s.run + 1 ELSE 1 END, 'best': greatest(s.best, CASE WHEN c.last > s.last THEN s.run + 1 ELSE 1 END)}}) AS r FROM vocabulary)
  SELECT token, CAST(r.best AS BIGINT) AS ramp, n FROM runs WHERE r.best >= 10"""


def t15_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.select("doc_id", "pos", "sentence", T.sentence_type(F.col("sentence")).alias("kind"))


T15 = f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s AS sentence, CASE WHEN {has('s', r'\?\s*$')} THEN 'question' WHEN {has('s', r'!\s*$')} THEN 'exclamation' ELSE 'statement' END AS kind
  FROM (SELECT doc_id, unnest({SENTENCES}) AS s, generate_subscripts({SENTENCES}, 1) AS i FROM documents)"""


def split_rows(column):
    return lambda spark, d: docs(spark, d).select("doc_id", F.posexplode(column(F.col("text"))).alias("pos", "sentence"))


_BARE = lambda c: f"list_filter(list_transform({c}, lambda s: {sub('s', r'^\s+|\s+$', '')}), lambda s: s <> '')"
_PARTS = _BARE(f"string_split({sub('text', r'([.!?])\s+|\n{2,}', chr(92) + '1' + chr(1))}, chr(1))")
PHRASES = f"flatten(list_transform({_PARTS}, lambda p: CASE WHEN length(p) > 80 THEN {_BARE(f'string_split({sub("p", r"(,)\s+", chr(92) + "1" + chr(1))}, chr(1))')} ELSE [p] END))"
ENDED = _BARE(f"regexp_extract_all(text, {q(r'([^.!?…]*[.!?…]+|[^.!?…]+$)')})")
_ROWS = lambda c: f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s AS sentence FROM (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, {c} AS x FROM documents))"


def t17_script_runs(spark: SparkSession, d: str) -> DataFrame:
    # A text's tokens hold no space, so they are dealt out as one string and their places; rows of one doc_id are merged.
    every = F.filter(F.transform(F.split("text", r"[ \n]+"), lambda w, i: F.struct(i.alias("pos"), w.alias("token"))), lambda x: x["token"].rlike("^[A-Za-z]{4,}$"))
    rows = docs(spark, d).select("doc_id", every.alias("x")).where("size(x) > 0").select("doc_id", F.struct(F.col("x.pos").alias("pos"), F.array_join("x.token", " ").alias("tokens")).alias("x"))
    apart = F.flatten(F.transform("x", lambda x: F.arrays_zip(x["pos"].alias("pos"), F.split(x["tokens"], " ").alias("token"))))
    merged = rows.groupBy("doc_id").agg(F.collect_list("x").alias("x")).select("doc_id", F.when(F.size("x") == 1, apart).otherwise(F.array_sort(apart)).alias("x"))
    mixed = merged.select("doc_id", F.array_join(F.transform("x", lambda x: F.concat(x["token"], F.lit(" "), F.translate(x["token"], "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстуввхыз"))), ", ").alias("text"))
    return mixed.select("doc_id", F.posexplode(T.script_runs(F.col("text"))).alias("pos", "x")).select("doc_id", "pos", "x.lang", "x.run")


RUNS = f"regexp_extract_all(text, {q(rf'({T.CYRILLIC}[^A-Za-z]*|{T.LATIN}[^А-Яа-яЁё]*)')})"
T17 = f"""WITH {TOKENS}, {NOISY}, mixed AS (SELECT doc_id, string_agg(concat(token, ' ', translate(token, 'abcdefghijklmnopqrstuvwxyz', 'абцдефгхийклмнопярстуввхыз')), ', ' ORDER BY pos) AS text FROM noisy GROUP BY doc_id)
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN {has('s', T.CYRILLIC)} THEN 'ru' ELSE 'en' END AS lang, trim(s) AS run FROM (SELECT doc_id, unnest({RUNS}) AS s, generate_subscripts({RUNS}, 1) AS i FROM mixed)"""


def t18_dialogue(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet").withColumn("line", F.expr("CASE turn % 4 WHEN 0 THEN concat(role, ': ', text) WHEN 1 THEN concat('[', role, '] ', text) WHEN 2 THEN concat(role, '> ', text) ELSE text END"))
    return rows.select("conv_id", "turn", T.speaker(F.col("line")).alias("speaker"), F.length("line").cast("long").alias("chars"))


SPEAKER = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(line, {q(p)}, 1)), '')" for p in (r"^\s*\[([^\]\[]{1,30})\]\s*\S", r"^\s*\(([^()]{1,30})\)\s*\S", r"^\s*([\p{L}\p{N}_ ]{1,30})\s*[:>]\s*\S")) + ")"
T18 = f"SELECT conv_id, turn, {SPEAKER} AS speaker, length(line) AS chars FROM (SELECT *, CASE turn % 4 WHEN 0 THEN concat(role, ': ', text) WHEN 1 THEN concat('[', role, '] ', text) WHEN 2 THEN concat(role, '> ', text) ELSE text END AS line FROM conversations)"


CLEAN_FIXES = {"thnt": "tent", "ndwh": "and"}


def t13_clean_audit(spark: SparkSession, d: str) -> DataFrame:
    """The clean chain without the lexicon: how many documents each stage changes."""
    stages = [x for x in clean_stages(CLEAN_FIXES) if x[1]]
    return stage_audit(clean_documents(dirty(spark, d), stages), stages)


def t13_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain, glued words split by the corpus' own lexicon."""
    known = build_lexicon(tokens(spark, d), 3)
    return clean_documents(dirty(spark, d), clean_stages(CLEAN_FIXES), known).select("doc_id", "text", F.array_join("changed", ",").alias("changed"), "ramp")


def t13_captions(spark: SparkSession, d: str) -> DataFrame:
    """The variant for captions: confused letters are mended too."""
    known = build_lexicon(tokens(spark, d), 3)
    return clean_documents(dirty(spark, d), CAPTION, known).select("doc_id", "text", F.array_join("changed", ",").alias("changed"), "ramp")


_S1 = _space_sql("text")
_H = lambda c: sub(c, r"(\p{L})-[ \t]*\n[ \t]*(\p{L})", r"\1\2")
_M = lambda c: sub(c, r"([\p{L}\p{N}]) ([,.!?:;]+)([\p{L}\p{N}])", r"\1\2 \3")
_GOOD = lambda c: f"array_to_string(list_filter({WORDS(c)}, lambda w: {has('w', '[А-Яа-яЁёA-Za-z]')} OR {has('w', '^[.,!?;:\\-\'\"()—–…/0-9]+$')}), ' ')"
_CASED = lambda put: f"CASE WHEN length(w) > 1 AND upper(w) = w THEN upper({q(put)}) WHEN substr(w, 1, 1) <> lower(substr(w, 1, 1)) THEN {q(put[0].upper() + put[1:])} ELSE {q(put)} END"
_FIX = "CASE lower(w) " + " ".join(f"WHEN {q(a)} THEN {_CASED(b)}" for a, b in CLEAN_FIXES.items()) + " ELSE w END"
_CLEAN = (
    ("space", _space_sql), ("scripts", lambda c: f"array_to_string(list_transform(regexp_extract_all({c}, '(\\s+|\\S+)'), lambda w: {repair_sql('w')}), '')"), ("hyphens", _H),
    ("tokens", lambda c: f"array_to_string(list_transform(string_split({c}, chr(10)), lambda l: {_GOOD('l')}), chr(10))"),
    ("fixes", lambda c: f"array_to_string(list_transform(regexp_extract_all({c}, '([A-Za-z]+|[^A-Za-z]+)'), lambda w: {_FIX}), '')"), ("decimals", _decimals_sql), ("space_again", _space_sql),
)


def _clean_sql() -> str:
    steps, before = [DIRTY], "text"
    for k, (name, change) in enumerate(_CLEAN):
        steps.append(f"s{k} AS (SELECT *, {change(before)} AS {name} FROM {f's{k - 1}' if k else 'dirty'})")
        before = name
    changed = ", ".join(f"count(*) FILTER (WHERE {b[0]} <> {a}) AS n_{b[0]}" for a, b in zip(("text", *(x[0] for x in _CLEAN)), _CLEAN, strict=False))
    ramp = f"len(list_filter(string_split_regex({before}, {q(T.RAMP_BREAKS)}), lambda w: length(w) >= 8 AND {_RUN('w')} >= 10)) > 0"
    return f"WITH {', '.join(steps)} SELECT count(*) AS n, {changed}, count(*) FILTER (WHERE {ramp}) AS n_ramps, CAST(sum(length({before})) AS BIGINT) AS chars FROM s{len(_CLEAN) - 1}"


def _RUN(c: str) -> str:
    """SQL for the longest rising run of code points."""
    return (
        f"list_reduce(list_transform(string_split({c}, ''), lambda c: {{'last': unicode(c), 'run': 1, 'best': 1}}),"
        " lambda s, c: {'last': c.last, 'run': CASE WHEN c.last > s.last THEN s.run + 1 ELSE 1 END, 'best': greatest(s.best, CASE WHEN c.last > s.last THEN s.run + 1 ELSE 1 END)}).best"
    )


T13 = _clean_sql()
F13_SAME = "len(list_intersect(list_distinct({a}), list_distinct({b})))"
FILTER_WORDS = WORDS("line")

QUERIES = {
    "s10_lines": (lines, f"WITH {LINES} SELECT doc_id, line_no, line FROM lines"),
    "t1_normalise_key": per_line(T.normalise_key, KEY("line")),
    "t2_lookalike_key": per_line(T.lookalike_key, f"translate({KEY('line')}, 'liosbgze', '11058923')"),
    "t3_homoglyphs": (lambda s, d: noisy(s, d).select("doc_id", "pos", "raw", T.repair_homoglyphs(F.col("raw")).alias("value")), f"WITH {TOKENS}, {NOISY} SELECT doc_id, pos, raw, {repair_sql('raw')} AS value FROM noisy"),
    "t4_inner_capitals": (
        lambda s, d: tokens(s, d).where(F.col("token").rlike("^[A-Za-z]+$")).select("doc_id", "pos", T.lower_inner_capitals(F.expr("CASE WHEN pos % 5 = 0 THEN concat(lower(substr(token, 1, 1)), upper(substr(token, 2, 2)), substr(token, 4)) ELSE token END")).alias("value")),
        f"""WITH {TOKENS}, x AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 0 THEN concat(lower(substr(token, 1, 1)), upper(substr(token, 2, 2)), substr(token, 4)) ELSE token END AS t FROM tokens WHERE {has('token', '^[A-Za-z]+$')})
        SELECT doc_id, pos, CASE WHEN upper(t) = t OR {has('t', '^[a-z]+[A-Z][a-z]+|^[A-Z][a-z]+[A-Z][a-z]+')} THEN t ELSE concat(substr(t, 1, 1), lower(substr(t, 2))) END AS value FROM x""",
    ),
    "t6_join_hyphens": (lambda s, d: hyphenated(s, d).select("doc_id", T.join_hyphens(F.col("text")).alias("value")), f"WITH {HYPHENATED} SELECT doc_id, {_H('text')} AS value FROM hyphenated"),
    "t7_normalise_space": per_doc(T.normalise_space, _S1),
    "t8_decimals": per_doc(T.trim_decimals, _decimals_sql("text")),
    "t9_letters_between_digits": (
        lambda s, d: lines(s, d).select("doc_id", "line_no", T.letters_between_digits(F.expr("concat(line, ' ', doc_id, 'l', line_no, 'O', doc_id)")).alias("value")),
        f"WITH {LINES} SELECT doc_id, line_no, {sub(sub('concat(line, chr(32), doc_id, chr(108), line_no, chr(79), doc_id)', r'(\d)[Il|](\d)', r'\11\2'), r'(\d)[OoОо](\d)', r'\10\2')} AS value FROM lines",
    ),
    "t10_strip_edges": per_line(T.strip_edges, sub("line", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.!?…]+$", "")),
    "t11_reattach_marks": (lambda s, d: lines(s, d).select("doc_id", "line_no", T.reattach_marks(F.regexp_replace("line", "([,.]) ", " $1")).alias("value")), f"WITH {LINES} SELECT doc_id, line_no, {_M(sub('line', '([,.]) ', r' \1'))} AS value FROM lines"),
    "t12_pause_dots": (
        lambda s, d: lines(s, d).select("doc_id", "line_no", T.pause_dots(F.regexp_replace("line", "[.,!?;:…]", "")).alias("value")),
        f"""WITH {LINES}, x AS (SELECT doc_id, line_no, {sub('line', '[.,!?;:…]', '')} AS t FROM lines), y AS (SELECT *, {WORDS('t')} AS w FROM x)
        SELECT doc_id, line_no, CASE WHEN len(w) < 3 OR length(array_to_string(w, '')) / len(w) < 5 THEN t ELSE array_to_string(list_transform(w, lambda x, i: CASE WHEN length(x) > 5 AND i < len(w) THEN concat(x, '.') ELSE x END), ' ') END AS value FROM y""",
    ),
    "t13_clean_audit": (t13_clean_audit, T13),
    "t13_clean_documents": (t13_clean_documents, None),
    "t13_captions": (t13_captions, None),
    "t15_sentences": (t15_sentences, T15),
    "t15_phrases": (split_rows(T.phrases), _ROWS(PHRASES)),
    "t15_ended": (split_rows(T.ended_sentences), _ROWS(ENDED)),
    "t17_script_runs": (t17_script_runs, T17),
    "t18_dialogue": (t18_dialogue, T18),
    "t20_pause_marks": per_line(T.pause_marks, _pauses_sql("line")),
    "f1_valid_lines": line_filter(T.is_valid_text, VALID),
    "f2_utterances": line_filter(lambda c: T.is_utterance(c, 2), f"length({KEY('line')}) >= 3 AND len({WORDS(KEY('line'))}) BETWEEN 2 AND 24 AND len(list_filter({WORDS(KEY('line'))}, lambda w: length(w) <= 1)) <= len({WORDS(KEY('line'))}) * 0.45 AND {n(KEY('line'), r'\p{L}')} >= 3"),
    "f3_garbage_rules": (lambda s, d: lines(s, d).select("doc_id", "line_no", T.garbage_rule(F.col("line")).alias("rule"), T.strip_icon(F.col("line")).alias("kept")), f"WITH {LINES} SELECT doc_id, line_no, {_garbage_sql()} AS rule, {sub('line', r'^[B-HJ-Zb-hj-z]\.? +(\S{2})', r'\1')} AS kept FROM lines"),
    "f4_good_tokens": per_line(T.keep_good_tokens, f"array_to_string(list_filter({WORDS('line')}, lambda w: {has('w', '[А-Яа-яЁёA-Za-z]')} OR {has('w', '^[.,!?;:\\-\'\"()—–…/0-9]+$')}), ' ')"),
    "f5_acceptable_script": per_line(T.acceptable_script, f"len(list_filter(list_transform({WORDS('line')}, lambda w: {sub('w', r'^[.,!?;:—–-]+|[.,!?;:—–-]+$', '')}), lambda w: NOT (w = '' OR {has('w', '^([А-Яа-яЁё]+|[A-Za-z]+)$')} OR ({has('w', T.CYRILLIC)} AND {has('w', T.LATIN)})))) = 0"),
    "f6_ramp_tokens": (f6_ramp_tokens, F6),
    "f7_keep_script": per_doc(lambda c: T.keep_script(c, "A-Za-z"), f"CASE WHEN length(trim({sub('text', '[^A-Za-z0-9 .,!?;:\\-\'\"()—–\\n]', '')})) > 0 THEN trim({sub('text', '[^A-Za-z0-9 .,!?;:\\-\'\"()—–\\n]', '')}) ELSE trim(text) END"),
    "f9_log_noise": (lambda s, d: lines(s, d).select("doc_id", "line_no", T.strip_log_noise(F.expr("concat('12:0', line_no % 10, ':07,123 [INFO] mod_name - ', line)")).alias("value")), f"WITH {LINES}, x AS (SELECT doc_id, line_no, concat('12:0', line_no % 10, ':07,123 [INFO] mod_name - ', line) AS l FROM lines) SELECT doc_id, line_no, {_log_sql('l')} AS value FROM x"),
    "f10_ansi": (lambda s, d: lines(s, d).select("doc_id", "line_no", T.strip_ansi(F.concat(F.lit("\x1b[31m"), F.col("line"), F.lit("\x1b[0m"))).alias("value")), f"WITH {LINES} SELECT doc_id, line_no, {sub('concat(chr(27), chr(91), chr(51), chr(49), chr(109), line, chr(27), chr(91), chr(48), chr(109))', r'\x1b\[[0-9;?]*[A-Za-z]', '')} AS value FROM lines"),
    "f18_short_lines": line_filter(T.long_enough, f"length(line) >= 3 AND {n('line', r'\p{L}')} >= 2"),
    "a6_script_profile": (a6_script_profile, A6),
    "a7_cyrillic_share": (a7_cyrillic_share, A7S),
    "a7_language_confusion": (a7_language_confusion, A7),
}
