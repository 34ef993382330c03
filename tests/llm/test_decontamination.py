"""Decontamination against brute force, and cutting."""

import hashlib
import random
import re

from cadence.llm import decontamination as de

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        if name is not None:
            for i in range(max(1, len(w) - 7) if w else 0):
                windows.setdefault(tuple(w[i : i + 8]), set()).add(str(name))
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for i in range(len(w)):
            for n in range(1, 9):
                names = windows.get(tuple(w[i : i + n])) if i + n <= len(w) else None
                if names:
                    hit.update(range(i, i + n))
                    found |= names
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    return out


def tables():
    rng = random.Random(6)
    vocabulary = ["Alpha", "beta", "é", "x1", "ÉT", "z-y"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 14)))) for k in range(12)] + [(50, None), (None, "Alpha beta"), (3, "a tied id")]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for k in range(60)] + [(90, None), (91, "")]
    docs += [(92, "start here! " + items[5][1] + " ... " + items[6][1] + " END")]
    return docs, items


def test_against_brute_force_and_in_blocks(spark):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {r["doc_id"]: tuple(r)[1:] for r in de.report(spark, d, b).collect()} == want
    parts = de.matches(spark, d, b, block_bytes=100).collect()
    assert {r["doc_id"]: sum(y - x for x, y in r["spans"]) for r in parts} == {k: v[1] for k, v in want.items()}
    assert {r["doc_id"]: len(r["items"]) for r in parts} == {k: v[2] for k, v in want.items()}
    assert de.report(spark, d, b.limit(0)).filter("n_hit > 0").count() == 0
    assert de.report(spark, d.limit(0), b).collect() == []


def test_cutting_keeps_what_is_clean(spark):
    item = "one two three four five six seven eight nine"
    docs = [(1, f"Before it: {item.upper()}. After", 7), (2, item, 7), (3, None, None), (4, "nothing here", 12)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: tuple(r) for r in de.cleaned(spark, d, b, coverage=0.8).collect()}
    assert got == {1: (1, "Before it: . After", 18), 3: (3, None, None), 4: (4, "nothing here", 12)}


def test_columns_of_any_name_are_kept(spark):
    item = "one two three four five six seven eight nine"
    extra = ["_spans", "spans", "ITEMS", "n_words", "digest", "spans_before", "_n_words"]
    table = spark.createDataFrame([(1, f"so {item} it is, and more of it", *range(7)), (1, f"so {item} it is, and more of it", *range(7)), (2, None, *range(7))], ["doc_id", "text", *extra])
    items = spark.createDataFrame([(1, item), (2, "another item of the benchmark that occurs nowhere")], "item_id long, text string")
    for got in (de.cleaned(spark, table, items, coverage=0.9), de.cleaned(spark, table.select(*table.columns), items, coverage=0.9)):
        assert got.columns == table.columns
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, "so  it is, and more of it", *range(7))] * 2 + [(2, None, *range(7))], key=str)
