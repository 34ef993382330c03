"""Line de-duplication against a plain version."""

import hashlib
import random

from cadence.llm import lines
from tests.llm import corpus


def plain(rows, how):
    seen, out = {}, {}
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: r[0]):
        parts = (text or "").split("\n")
        kept, removed = [], 0
        done = 0
        for a, b in lines.chunks(parts, how) if text else []:
            body = "\n".join(parts[a:b])
            if lines._removable(parts, a, b, how):
                if body in seen:
                    kept += parts[done:a]
                    done = b
                    removed += b - a
                seen.setdefault(body, doc)
        kept += parts[done:]
        out[doc] = (len(parts) if text else 0, removed, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def rows():
    base = corpus.documents(3)
    shared = "\n".join(f"shared line number {k} of a notice that many pages carry" for k in range(12))
    return base + [(200 + k, f"own {k} first\n{'x' * k}\n{shared}\nown {k} last", "en", "s", 0) for k in range(5)]


def test_against_plain_version(spark):
    table = spark.createDataFrame(rows(), corpus.SCHEMA)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in lines.report(spark, table).collect()}
    assert got == plain(rows(), lines.Chunking())
    assert sum(r[1] for r in got.values()) > 20
    assert lines.report(spark, table.limit(0)).collect() == []


def test_boundaries_survive_shifts():
    shared = [f"line {k} of a long shared passage" for k in range(40)]
    how = lines.Chunking()
    a, b = ["p"] + shared, ["q", "r", "s"] + shared
    bodies = [{tuple(x[s:e]) for s, e in lines.chunks(x, how)} for x in (a, b)]
    assert len(bodies[0] & bodies[1]) >= 5


def test_stage_keeps_columns_and_clashing_names(spark):
    table = spark.createDataFrame([(1, "a\n" * 30 + "end of it all, and more", 9), (2, "a\n" * 30 + "end of it all, and more", 9), (None, "b", 1)], "doc_id long, text string, first long")
    got = lines.thinned(spark, table)
    assert got.columns == table.columns
    assert {r["doc_id"] for r in got.collect()} <= {1, 2, None} and got.filter("doc_id = 1").first()["text"].endswith("more")


def planted():
    """Foreign lines around passages of 1 to 6 lines, runs of equal lines, blanks, and whole copies."""
    rng = random.Random(4)

    def foreign():
        return ["".join(rng.choices("abcdefgh ", k=rng.choice([3, 9, 50]))) for _ in range(rng.randint(0, 4))]

    shared = [[f"passage {p} line {k} " + "x" * rng.choice([0, 8, 40]) for k in range(1 + p % 6)] for p in range(12)]
    shared += [["", "", "short", "", "a line of some forty characters or more", ""], ["same line again " * 3] * 5]
    out = []
    for k in range(40):
        parts = foreign()
        for p in rng.sample(shared, 3):
            parts += p + foreign()
        out.append((k, "\n".join(parts)))
    return [*out, (50, out[3][1]), (51, "\n" * 200 + out[4][1]), (52, None), (53, "")]


def every_passage(rows, how):
    """The lines in any removable passage that stands earlier, by trying every passage."""
    seen, out = {}, {}
    for doc, text in rows:
        parts = (text or "").split("\n") if text else []
        gone = set()
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                if lines._removable(parts, a, b, how):
                    at = seen.setdefault("\n".join(parts[a:b]), (doc, a))
                    if at[0] != doc or a - at[1] >= b - a:
                        gone.update(range(a, b))
        kept = "\n".join(x for k, x in enumerate(parts) if k not in gone)
        out[doc] = (len(parts), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_every_repeated_passage_goes_whatever_surrounds_it(spark):
    how = lines.Passages(most_blank=300)
    table = spark.createDataFrame(planted(), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in lines.report(spark, table, how=how).collect()}
    assert got == every_passage(planted(), how)
    assert sum(r[1] for r in got.values()) > 200
    left = "\n".join(r["text"] or "" for r in lines.thinned(spark, table).collect())
    for p in (2, 3, 4, 5, 8, 9, 10, 11):
        assert left.count(f"passage {p} line 0 ") == 1


def test_long_blank_runs_list_few_passages():
    found = lines.passages([""] * 5000 + ["x" * 50, "y" * 50] + [""] * 5000, lines.Passages())
    assert 0 < len(found) < 500 and max(b - a for a, b in found) < 100


def test_equal_hashes_of_other_bytes_stay(spark, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(lines, "repeats", lambda scratch, keyed, how: spark.createDataFrame(
            [(1, "a\nb", [(0, 2, 5, 5, True)]), (2, "c\nd\na\nb", [(0, 2, 5, 5, False), (2, 4, 5, 5, False)])],
            "row long, text string, some array<struct<first:int,stop:int,high:long,low:long,own:boolean>>").selectExpr("row", "xxhash64(text) AS mark", "some"))
        table = spark.createDataFrame([(1, "a\nb"), (2, "c\nd\na\nb"), (3, None)], "doc_id long, text string")
        got = {r["doc_id"]: r["text"] for r in lines.deduplicated(spark, table).collect()}
    assert got == {1: "a\nb", 2: "c\nd", 3: None}


def test_rows_that_repeat_an_id_are_told_apart_by_their_texts(spark):
    t = "\n".join(f"line number {k} of a notice that is repeated" for k in range(12))
    u = "\n".join(f"unique line {k} of another text altogether" for k in range(12))
    schema = "doc_id long, text string"
    got = lines.report(spark, spark.createDataFrame([(1, t), (1, t), (2, t)], schema)).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_removed"]) for r in got) == [(1, 12, 0), (1, 12, 0), (2, 12, 12)]
    kept = lines.thinned(spark, spark.createDataFrame([(1, t), (2, t), (2, u), (3, t + "\n" + u)], schema)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, t), (2, u)]
    many = spark.createDataFrame([(k % 3, t) for k in range(60)], schema)
    got = lines.report(spark, many).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(0, 0)] * 20 + [(1, 12)] * 20 + [(2, 12)] * 20


def test_columns_of_any_name_are_kept(spark):
    t = "\n".join(f"line number {k} of a notice that is repeated" for k in range(4))
    extra = ["_n_lines", "n_lines", "N_REMOVED", "row", "_row", "mark", "some", "_some", "unlike", "_cut"]
    table = spark.createDataFrame([(k, t + f"\nown end of text number {k}", *range(len(extra))) for k in range(3)], ["doc_id", "text", *extra])
    got = lines.thinned(spark, table)
    assert got.columns == table.columns
    assert sorted(tuple(r) for r in got.collect()) == [(k, t + "\nown end of text number 0" if not k else f"own end of text number {k}", *range(len(extra))) for k in range(3)]
