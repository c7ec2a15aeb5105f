"""Tables derived from the given ones: a DataFrame function and a SQL body for each.

Times are milliseconds since 2024-01-01.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captext.operators.lines import explode_tokens


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


WORDS = "list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> '')"
SQL = {
    "captures": f"""SELECT conv_id AS stream_id, turn * 3 + copy AS seq, conv_id * 3600000 + (turn * 3 + copy) * 600 AS t,
      CASE WHEN copy = 0 THEN array_to_string(list_slice({WORDS}, 1, CAST(ceil(len({WORDS}) / 2) AS BIGINT)), ' ') ELSE array_to_string({WORDS}, ' ') END AS text,
      CAST(40 + (turn * 37 + copy * 11) % 60 AS DOUBLE) AS conf FROM conversations, (VALUES (CAST(0 AS BIGINT)), (1), (2)) c(copy)""",
    "speech": """SELECT conv_id AS stream_id, turn AS seq, conv_id * 3600000 + turn * 4000 AS t0, conv_id * 3600000 + turn * 4000 + 1000 + (length(text) % 30) * 100 AS t1, text,
      CAST((turn * 13 + conv_id) % 100 AS DOUBLE) / 100 AS no_speech, CAST(-((turn * 7 + conv_id) % 150) AS DOUBLE) / 100 AS logprob, 1 + CAST((turn * 11 + conv_id) % 200 AS DOUBLE) / 100 AS compression,
      CASE conv_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'ru' END AS lang FROM conversations WHERE role = 'user'""",
    "subtitles": """SELECT stream_id, t0 + ((seq % 5) - 1) * 2500 AS t, regexp_replace(text, ' [^ ]*$', '') AS text, seq FROM speech WHERE seq % 7 <> 0
      UNION ALL SELECT conv_id, conv_id * 3600000 + turn * 4000, text, turn + 100000 FROM conversations WHERE role = 'assistant'""",
    "playback": "SELECT conv_id AS stream_id, conv_id * 3600000 + turn * 4000 AS t0, conv_id * 3600000 + turn * 4000 + 2000 AS t1, text FROM conversations WHERE role = 'assistant'",
    "tokens": """SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, x AS token FROM (
      SELECT doc_id, unnest(string_split_regex(text, '[ \\n]+')) AS x, generate_subscripts(string_split_regex(text, '[ \\n]+'), 1) AS i FROM documents) WHERE x <> ''""",
    "boxes": """SELECT doc_id * 1000000 + pos // 40 AS frame_id, pos % 40 AS pos, CAST(80 * (pos % 8) AS DOUBLE) AS x0, CAST(20 * (pos % 40 // 8) + (pos * 5) % 4 AS DOUBLE) AS y0, CAST(80 * (pos % 8) + 8 * length(token) AS DOUBLE) AS x1,
      CAST(20 * (pos % 40 // 8) + (pos * 5) % 4 + 14 AS DOUBLE) AS y1, token AS text, CAST((doc_id * 7 + pos * 13) % 100 AS DOUBLE) AS conf FROM tokens""",
    "frames": """SELECT label AS stream_id, vec_id AS seq, list_transform(embedding, lambda e: round((CAST(e AS DOUBLE) + 1) * 127.5, 3)) AS luma FROM embeddings""",
    "providers": """SELECT doc_id, lang, r AS rank, concat('p', r) AS provider, CASE (doc_id * r) % 4 WHEN 0 THEN NULL WHEN 1 THEN '[x failed]' WHEN 2 THEN text ELSE concat('>> ', text) END AS result,
      CAST(100 + (doc_id * 31 + r * 17) % 900 AS BIGINT) AS latency_ms FROM documents, (VALUES (CAST(1 AS BIGINT)), (2), (3)) p(r)""",
    "lexicon": """SELECT lower(token) AS word, count(*) AS freq FROM tokens WHERE regexp_matches(token, '^\\p{L}+$') GROUP BY 1 HAVING count(*) >= 3""",
    "settings_a": "SELECT concat(user_id, '.', event_type) AS path, CAST(count(*) AS VARCHAR) AS value FROM events WHERE day(ts) <= 20 GROUP BY 1",
    "settings_b": "SELECT concat(user_id, '.', event_type) AS path, CAST(count(*) AS VARCHAR) AS value FROM events WHERE day(ts) >= 11 GROUP BY 1",
}
NEEDS = {"subtitles": ("speech",), "boxes": ("tokens",), "lexicon": ("tokens",)}


def ctes(*names: str) -> str:
    """WITH clauses of views and what they need, without the WITH."""
    order: list[str] = []
    for name in names:
        order += [x for x in (*NEEDS.get(name, ()), name) if x not in order]
    return ", ".join(f"{x} AS ({SQL[x]})" for x in order)


def captures(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("w", F.expr(r"filter(split(text, '[ \n]+'), w -> w <> '')")).withColumn("copy", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))))
    return rows.selectExpr("conv_id AS stream_id", "turn * 3 + copy AS seq", "conv_id * 3600000 + (turn * 3 + copy) * 600 AS t", "array_join(CASE WHEN copy = 0 THEN slice(w, 1, cast(ceil(size(w) / 2) AS int)) ELSE w END, ' ') AS text", "cast(40 + (turn * 37 + copy * 11) % 60 AS double) AS conf")


def speech(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").selectExpr(
        "conv_id AS stream_id", "turn AS seq", "conv_id * 3600000 + turn * 4000 AS t0", "conv_id * 3600000 + turn * 4000 + 1000 + (length(text) % 30) * 100 AS t1", "text",
        "cast((turn * 13 + conv_id) % 100 AS double) / 100 AS no_speech", "cast(-((turn * 7 + conv_id) % 150) AS double) / 100 AS logprob", "1 + cast((turn * 11 + conv_id) % 200 AS double) / 100 AS compression",
        "CASE conv_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'ru' END AS lang",
    )


def subtitles(spark: SparkSession, d: str) -> DataFrame:
    own = speech(spark, d).where("seq % 7 <> 0").selectExpr("stream_id", "t0 + ((seq % 5) - 1) * 2500 AS t", "regexp_replace(text, ' [^ ]*$', '') AS text", "seq")
    return own.unionByName(table(spark, d, "conversations").where("role = 'assistant'").selectExpr("conv_id AS stream_id", "conv_id * 3600000 + turn * 4000 AS t", "text", "turn + 100000 AS seq"))


def playback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'assistant'").selectExpr("conv_id AS stream_id", "conv_id * 3600000 + turn * 4000 AS t0", "conv_id * 3600000 + turn * 4000 + 2000 AS t1", "text")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return explode_tokens(table(spark, d, "documents"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """All tokens of the documents, 40 to a frame, in rows of eight."""
    return tokens(spark, d).selectExpr(
        "doc_id * 1000000 + pos div 40 AS frame_id", "pos % 40 AS pos", "cast(80 * (pos % 8) AS double) AS x0", "cast(20 * (pos % 40 div 8) + (pos * 5) % 4 AS double) AS y0", "cast(80 * (pos % 8) + 8 * length(token) AS double) AS x1",
        "cast(20 * (pos % 40 div 8) + (pos * 5) % 4 + 14 AS double) AS y1", "token AS text", "cast((doc_id * 7 + pos * 13) % 100 AS double) AS conf",
    )


def frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr("label AS stream_id", "vec_id AS seq", "transform(embedding, e -> round((cast(e AS double) + 1) * 127.5, 3)) AS luma")


def providers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("rank", F.explode(F.array(*(F.lit(i).cast("long") for i in (1, 2, 3)))))
    return rows.selectExpr(
        "doc_id", "lang", "rank", "concat('p', rank) AS provider", "CASE (doc_id * rank) % 4 WHEN 0 THEN NULL WHEN 1 THEN '[x failed]' WHEN 2 THEN text ELSE concat('>> ', text) END AS result",
        "100 + (doc_id * 31 + rank * 17) % 900 AS latency_ms",
    )


def lexicon(spark: SparkSession, d: str, least: int = 3) -> DataFrame:
    from captext.operators.lexicon import build_lexicon

    return build_lexicon(tokens(spark, d), least)


def settings(spark: SparkSession, d: str, days: str) -> DataFrame:
    return table(spark, d, "events").where(f"day(ts) {days}").groupBy(F.expr("concat(user_id, '.', event_type)").alias("path")).agg(F.count("*").cast("string").alias("value"))
