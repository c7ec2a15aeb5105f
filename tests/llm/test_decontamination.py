"""op11 against a plain version and its SQL; nulls, ties, repeats, short items, long texts, blocks."""

from __future__ import annotations

import hashlib
import re

import duckdb
import pytest

from captext.llm.decontamination import SQL, contaminated_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
EMPTY = hashlib.sha256(b"").hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, benchmark, width=10):
    windows = {}
    for item, text in benchmark:
        w = words(text)
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        names = sorted(str(x) for x in items if x is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [
    (10, PASSAGE), (9, PASSAGE + " thirteen"), (9, "Quite another text of the item that has this number, with several more words"), (2, "short item"), (3, "Solo"), (4, "a b c"), (5, None), (6, " .,; "),
    (None, "an item without a number still hits what documents have of it today and tomorrow"), (7, "la la la la la la la la la la la la la"), (8, "Straße ÉTÉ naïve 中文 русский текст für alle 42 x9 Ünder"),
]
DOCS = [
    (1, f"before {PASSAGE.upper()} after"), (1, f"before {PASSAGE.upper()} after"), (1, "the same number with another text: short ITEM"), (2, None), (3, ""), (4, "!!! ..."), (5, "solo"), (6, "xsolo solox a b, c a-b-c short. item"),
    (7, " ".join(["la"] * 40)), (8, " ".join(["la"] * 9)), (None, PASSAGE), (9, "one two three four five six seven eight nine twelve ten"), (10, "an item without a number still hits what documents have"),
    (11, "x straße ÉTÉ naïve 中文 русский текст für alle 42 x9 Ünder y"), (12, "x straße été naïve 中文 русский текст für alle 42 x9 ünder y"), (13, "filler and more " * 20000 + PASSAGE + " short item" + " filler" * 30000), (14, "tail short"), (15, "\x00short\x7fitem\x00"),
]


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("block", [200_000, 3])
def test_against_plain(spark, block):
    docs = spark.createDataFrame([(*d, 7, "x", 1) for d in DOCS], "doc_id long, text string, sum long, split string, gram int")
    items = spark.createDataFrame([(*b, 1) for b in ITEMS], "item_id long, text string, digest int")
    assert rows(contaminated_documents(docs, items, block=block)) == plain(DOCS, ITEMS)


def test_long_items_only_and_other_widths(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([(1, PASSAGE), (2, "six seven eight nine")], "item_id long, text string")
    for width in (1, 2, 4, 12):
        assert rows(contaminated_documents(docs, items, width)) == plain(DOCS, [(1, PASSAGE), (2, "six seven eight nine")], width)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(contaminated_documents(docs.limit(0), items)) == []
    found = rows(contaminated_documents(docs, items.limit(0)))
    assert len(found) == len(DOCS) and {r[2:] for r in found} == {(0, 0, EMPTY, False)}


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    found = contaminated_documents(*(spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark")))
    assert rows(found) == sorted(con.sql(SQL).fetchall(), key=str)


def test_no_python_on_the_main_path(spark):
    d = "/root/testdata/sf0.001"
    found = contaminated_documents(*(spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark")))
    assert not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().toString())
