import hashlib
import random

from gridspark.llm import common
from gridspark.llm import line_dedup as d
from tests.llm.helpers import collect, docs, odd_rows

SPACE = " \t\n\x0b\x0c\r"
LOW = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    last = lambda i: d.LAST_ID if i is None else i
    key = lambda line: line.strip(SPACE).translate(LOW)
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), d.LAST_ID + 1), last(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == last(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(str, out))


def rows_with_shared_lines():
    rng = random.Random(1)
    pool = [f"Shared line number {i} " for i in range(30)] + ["", "short", "  padded shared line\t", "ÄÖ shared umlaut line", "äö SHARED umlaut line"]
    return odd_rows() + [(100 + i, "\n".join([rng.choice(pool) for _ in range(rng.randint(1, 90))] + ["common to every document"] * (i % 2))) for i in range(80)]


def test_against_brute_force(spark):
    rows = rows_with_shared_lines()
    got = collect(d.line_report(docs(spark, rows)))
    assert sorted(str((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"])) for r in got) == brute(rows)


def test_one_salt_is_as_good_as_many(spark):
    table = docs(spark, rows_with_shared_lines())
    key = lambda r: (r["doc_key"], r["text_key"])
    assert sorted(collect(d.keep_bitmaps(table, salts=1)), key=key) == sorted(collect(d.keep_bitmaps(table, salts=64)), key=key)


def test_hot_lines_are_dropped_as_all_others(spark):
    table = docs(spark, rows_with_shared_lines())
    key = lambda r: (r["doc_key"], r["text_key"])
    expected = sorted(collect(d.keep_bitmaps(table)), key=key)
    for hot_least in (0, 30, 70):  # all slots with lines are hot, some are, a single one is
        assert sorted(collect(d.keep_bitmaps(table, salts=4, hot_least=hot_least)), key=key) == expected


def test_hot_slots(spark):
    rows = spark.range(3000).selectExpr("if(id < 1000, -7L, id * 65536 + id) as h")
    assert common.hot_slots(rows, "h", 1000) is None
    hot = common.hot_slots(rows, "h", 999)
    assert rows.where(hot).distinct().collect() == [(-7,)]
    assert rows.where(~hot).count() == 2000


def test_texts_and_columns(spark):
    table = docs(spark, [(1, "the first line\nown"), (2, "THE FIRST LINE\r\nstays"), (3, None), (4, "the first line")])
    done = d.line_dedup(table)
    assert done.columns == table.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in done.collect()} == {1: ("the first line\nown", 18), 2: ("stays", 5), 3: (None, None), 4: ("", 0)}
    assert d.line_report(table.where("false")).count() == 0


def test_long_document_bitmap(spark):
    lines = [f"line of the long one {i}" for i in range(5000)]
    table = docs(spark, [(1, "\n".join(lines[::3])), (2, "\n".join(lines))])
    (bitmap,) = collect(d.keep_bitmaps(table))
    gone = {w["word"] * 64 + b for w in bitmap["dropped"] for b in range(64) if w["bits"] >> b & 1}
    assert gone == set(range(0, 5000, 3))
    assert {r["doc_id"]: r["n_dropped"] for r in collect(d.line_report(table))} == {1: 0, 2: len(lines[::3])}
