import random
import re

from gridspark.llm import decontaminate as d
from tests.llm.helpers import collect, docs, odd_rows, prose


def shingles(text):
    w = re.sub(r"[!-/:-@\[-`{-~]", " ", (text or "").lower())
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, items):
    best = {}
    for i, x in rows:
        for j, y in items:
            a, b = shingles(x), shingles(y)
            if b and len(a & b) >= 0.8 * len(b) - 1e-9:
                best[i, j] = max(best.get((i, j), (0, 0)), (len(a & b) / len(b), len(a & b)))
    return {k: v[1] for k, v in best.items()}


def cases():
    rng = random.Random(1)
    items = [(i, prose(rng, rng.randint(12, 60))) for i in range(40)] + [(90, None), (91, ""), (92, "a b c d"), (93, " ... "), (None, prose(rng, 30)), (94, prose(rng, 5)), (0, prose(rng, 20))]
    rows = odd_rows()
    for k in range(150):
        item = rng.choice([t for _, t in items if t and len(t) > 20]).split(" ")
        for _ in range(rng.randint(0, 3)):
            item[rng.randrange(len(item))] = "edited"
        filling = prose(rng, rng.randint(0, 400)).split(" ")
        at = rng.randint(0, len(filling))
        rows.append((200 + k, " ".join(filling[:at] + (item if k % 3 else item[: len(item) // 2]) + filling[at:]).upper()))
    return rows, items + items[:3]


def test_against_brute_force(spark):
    rows, items = cases()
    table, bench = docs(spark, rows), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = brute(rows, items)
    for block in (500_000, 50):
        got = collect(d.containment_matches(table, bench, block_shingles=block))
        assert {(r["doc_id"], r["item_id"]): r["n_shared"] for r in got} == want and len(got) == len(want)
    assert len(want) > 25
    assert d.containment_matches(table.where("false"), bench).count() == 0
    assert d.containment_matches(table, bench.where("false")).count() == 0


def test_sketch_finds_every_item_at_the_threshold():
    rng = random.Random(2)
    for n in (5, 9, 10, 11, 30):
        words = [f"w{i}" for i in range(n + 4)]
        sketches = d.Sketches([(1, " ".join(words))], 0.8, 5)
        for _ in range(20):
            kept = rng.sample(range(n), -(-4 * n // 5))
            text = " ; zz ".join(" ".join(words[i : i + 5]) for i in kept)
            found = d.words_of(text)
            assert list(sketches.matches(found, d.word_hashes(found))) != []


def test_drop(spark):
    rng = random.Random(3)
    item = prose(rng, 30)
    table = docs(spark, [(1, "start " + item + " end"), (2, prose(rng, 50)), (3, None), (None, "fine text of more than five words")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = d.drop_contaminated(table, bench)
    assert kept.columns == table.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["2", "3", "None"]


def test_drop_spares_other_rows_of_the_same_id(spark):
    rng = random.Random(4)
    item, clean = prose(rng, 30), prose(rng, 50)
    table = docs(spark, [(None, item), (None, clean), (7, item), (7, clean), (None, None)])
    kept = d.drop_contaminated(table, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(None, clean), (7, clean), (None, None)]))
