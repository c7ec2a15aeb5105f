"""Folder scans, batch jobs over files, and text sinks that are read back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captext.functions.text import time_text
from captext.session import scratch

RULE = "─" * 40


def scan_files(spark: SparkSession, path: str, extensions: tuple[str, ...], recursive: bool = True) -> DataFrame:
    """path, length and content of the files with one of the extensions, in any case, by path; content is read only if it is used."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return read.where(F.lower("path").rlike(rf"\.({'|'.join(e.lstrip('.').lower() for e in extensions)})$")).orderBy("path")


def batch_process(rows: DataFrame, recognise: Callable[[str], str], key: str, text: str) -> DataFrame:
    """key, text, success, error, chars and lines of a callable run on each row; a failing row is reported and the rest go on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, value in zip(frame[key], frame[text], strict=True):
                try:
                    found = recognise(value)
                    out.append((k, found, True, None, len(found), found.count("\n") + 1))
                except Exception as e:
                    out.append((k, None, False, type(e).__name__, None, None))
            yield pd.DataFrame(out, columns=["key", "text", "success", "error", "chars", "lines"]).astype({"chars": "Int64", "lines": "Int64"})

    return rows.select(key, text).mapInPandas(run, "key long, text string, success boolean, error string, chars long, lines long")


#: Fields of a history entry, with what an absent one is.
HISTORY = {"timestamp": 0.0, **dict.fromkeys(("source_text", "translated_text", "source_lang", "target_lang", "ocr_text", "voice_preset", "image_path"), "")}
#: Columns of a history as a table for people: when, and what was said.
EXPORTED = ("time_str", "source_lang", "target_lang", "source_text", "translated_text", "ocr_text", "voice_preset")


def new_history(spark: SparkSession) -> str:
    return scratch(spark, "history")


def _entries(rows: DataFrame) -> DataFrame:
    return rows.select(*((F.coalesce(F.col(c).cast("double" if c == "timestamp" else "string"), F.lit(v)) if c in rows.columns else F.lit(v)).alias(c) for c, v in HISTORY.items()))


def append_history(rows: DataFrame, path: str) -> None:
    """Add rows, which may lack fields, to a history. Each append is a commit of its own."""
    _entries(rows).write.mode("append").parquet(path)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """The entries with time_str; fields that a file lacks have their defaults."""
    schema = ", ".join(f"{c} {'double' if c == 'timestamp' else 'string'}" for c in HISTORY)
    return _entries(spark.read.schema(schema).parquet(path)).withColumn("time_str", time_text(F.col("timestamp").cast("long")))


def search_history(rows: DataFrame, words: str | None = None, langs: list[str] | None = None) -> DataFrame:
    """Entries one of whose three texts contains `words` in any case, in one of the source languages."""
    if words is not None:
        has = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(words.lower())) for c in ("source_text", "translated_text", "ocr_text")]
        rows = rows.where(has[0] | has[1] | has[2])
    return rows if langs is None else rows.where(F.col("source_lang").isin(langs))


def export_history(rows: DataFrame, path: str) -> None:
    """The EXPORTED columns as CSV with a header; line breaks in a text are kept."""
    rows.select(*EXPORTED).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def import_history(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Entries of an exported CSV, stamped `now`: the table has neither times nor images."""
    schema = ", ".join(f"{c} string" for c in EXPORTED)
    held = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    return _entries(held.withColumn("timestamp", now))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """The distinct words of lists of one word a line, gzip or plain: trimmed, lower case, ё as е; blank lines go."""
    return spark.read.text(path).select(F.translate(F.lower(F.trim("value")), "ё", "е").alias("word")).where("word <> ''").distinct()


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions of JSON files, each a list of objects: name, x, y, w, h (0 where absent) and locked (false)."""
    held = spark.read.option("multiLine", True).schema("name string, x double, y double, width double, height double, locked boolean").json(path)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return held.select("name", zero("x").alias("x"), zero("y").alias("y"), zero("width").alias("w"), zero("height").alias("h"), F.coalesce("locked", F.lit(False)).alias("locked"))


def setting(tree: Column, path: str, default: str) -> Column:
    """The value at a dotted path of a JSON tree, or the default."""
    return F.coalesce(F.get_json_object(tree, f"$.{path}"), F.lit(default))


def flatten_settings(rows: DataFrame, key: str, tree: str, levels: int = 8) -> DataFrame:
    """key, path (dotted) and value of the leaves of a JSON tree, down to `levels`; deeper trees stay JSON."""
    held = rows.select(key, F.lit("").alias("path"), F.col(tree).alias("value"))
    done = None
    for _ in range(levels):
        inner = held.withColumn("_m", F.from_json("value", "map<string, string>"))
        branch = F.col("value").rlike(r"^\s*\{") & F.col("_m").isNotNull()
        leaves = inner.where(~F.coalesce(branch, F.lit(False))).select(key, F.expr("substr(path, 2)").alias("path"), "value")
        done = leaves if done is None else done.union(leaves)
        held = inner.where(branch).select(key, "path", F.explode("_m").alias("_k", "value")).select(key, F.concat("path", F.lit("."), "_k").alias("path"), "value")
        if held.limit(1).count() == 0:
            return done
    return done.union(held.select(key, F.expr("substr(path, 2)").alias("path"), "value"))


def set_setting(flat: DataFrame, key: str, path: str, value: str) -> DataFrame:
    """Flattened settings with the value at a path put anew for each key; what stood there or below it goes."""
    rest = flat.where((F.col("path") != path) & ~F.col("path").startswith(path + "."))
    return rest.union(flat.select(key).distinct().select(key, F.lit(path), F.lit(value)))


#: Recognisers by name.
RECOGNISERS: dict[str, Callable[[], Callable[[str], str]]] = {}


def register_recogniser(name: str, make: Callable[[], Callable[[str], str]]) -> None:
    """Keep what makes a recogniser under a name."""
    RECOGNISERS[name] = make


def recogniser(name: str) -> Callable[[str], str]:
    """A new recogniser of that name; KeyError with the known names if there is none."""
    if name not in RECOGNISERS:
        raise KeyError(f"no recogniser {name!r}; known: {', '.join(sorted(RECOGNISERS))}")
    return RECOGNISERS[name]()


def _guarded(text: Column, mark: str) -> Column:
    """text with one more backslash before each line that begins with the mark, or with backslashes and the mark."""
    return F.regexp_replace(text, rf"(?m)^(\\*{mark})", r"\\$1")


def _restored(text: Column, mark: str) -> Column:
    return F.regexp_replace(text, rf"(?m)^\\(\\*{mark})", "$1")


def write_capture_log(rows: DataFrame, path: str) -> None:
    """One text record a capture: `[at] (conf%, seconds)`, the text, a rule."""
    head = F.format_string("[%s] (%s%%, %s)", "at", F.col("conf").cast("int").cast("string"), F.format_number("scan_s", 1))
    rows.select(F.concat(head, F.lit("\n"), _guarded(F.col("text"), RULE))).write.option("lineSep", f"\n{RULE}\n").text(path)


def read_capture_log(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", f"\n{RULE}\n").text(path)
    part = lambda i: F.regexp_extract("value", r"(?s)^\[([^\]]*)\] \((\d+)%, ([0-9.]+)\)\n(.*)$", i)
    return raw.select(part(1).alias("at"), part(2).cast("double").alias("conf"), part(3).cast("double").alias("scan_s"), _restored(part(4), RULE).alias("text"))


def valid_regions(regions: DataFrame) -> DataFrame:
    """Regions that are large enough to read (wider than 30, higher than 12) and not locked."""
    return regions.where((F.col("w") > 30) & (F.col("h") > 12) & ~F.coalesce("locked", F.lit(False)))


#: Columns of a batch's results as CSV.
RESULT = ("filename", "text", "chars", "lines", "error")
#: What a spreadsheet takes as the sign of UTF-8.
BOM = "\ufeff"


def write_results(rows: DataFrame, path: str) -> None:
    """A batch's results (RESULT, success) below path as `csv` (those columns, a byte order mark before each file's header), `json` and `txt` (a block a file)."""
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    plain = rows.select("filename", none("text", ""), none("chars", 0), none("lines", 0), none("error", ""))
    csv = plain.toDF(BOM + "filename", *RESULT[1:])
    csv.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(f"{path}/csv")
    rows.write.json(f"{path}/json")
    plain.select(F.concat(F.lit("=== "), "filename", F.lit(" ===\n"), _guarded(F.col("text"), "=== "))).write.option("lineSep", "\n\n").text(f"{path}/txt")


def read_results(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """filename and text of one of the sinks of write_results()."""
    if kind == "json":
        return spark.read.schema("filename string, text string").json(f"{path}/json")
    if kind == "csv":
        schema = "filename string, text string, chars long, lines long, error string"
        return spark.read.option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').schema(schema).csv(f"{path}/csv").select("filename", F.coalesce("text", F.lit("")).alias("text"))
    # A block begins where a line is a name between bars; what stands before the first one is no block.
    held = spark.read.option("lineSep", "\n\n=== ").text(f"{path}/txt").select(F.regexp_replace("value", r"^=== |\n\n$", "").alias("v"))
    part = lambda i: F.regexp_extract("v", r"(?s)^(.*?) ===\n(.*)$", i)
    return held.select(part(1).alias("filename"), _restored(part(2), "=== ").alias("text")).where("filename <> ''")


@F.udtf(returnType="pos int, sentence string")
class SplitSentences:
    """The sentences of a text with their end marks, as a table function."""

    def eval(self, text: str):
        import re

        found = (s.strip(" ") for s in re.findall(r"[^.!?…\n]+[.!?…]*", text or ""))
        for i, s in enumerate(s for s in found if s):
            yield i, s
