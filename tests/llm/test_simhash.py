import random

import numpy as np
import pytest
import xxhash

from gridspark.llm import simhash as s
from tests.llm.helpers import collect, docs, odd_rows, prose


def brute_print(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute(rows):
    """Nodes are documents by their doc_id; each row without one is a node of its own, after all others."""
    prints = [brute_print(t) for _, t in rows]
    ids = [s.LAST_ID + k if i is None else i for k, (i, _) in enumerate(rows)]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    last = lambda x: None if x >= s.LAST_ID else x
    return sorted(str((i, format(p, "016x"), last(find(k)))) for (i, _), p, k in zip(rows, prints, ids))


@pytest.mark.parametrize("bucket_rows", [256, 2])
def test_components(spark, bucket_rows):
    rng = random.Random(1)
    rows = odd_rows()
    for i in range(20):
        base = prose(rng, 400).split(" ")
        rows.append((100 + 10 * i, " ".join(base)))
        for k in range(1, 5):
            base = list(base)
            base[rng.randrange(len(base))] = "changed"
            rows.append((100 + 10 * i + k, " ".join(base)))
    got = s.simhash_components(docs(spark, rows), bucket_rows=bucket_rows)
    assert sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in collect(got)) == brute(rows)


def test_crowded_bucket_loses_no_link(spark):
    """A ball of many fingerprints around one, and a chain, by both ways."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 150:
        x = centre
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        prints.add(x)
    chain = rng.getrandbits(64)
    for b in range(0, 60, 3):
        chain ^= 7 << b
        prints.add(chain)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(p - (p >> 63 << 64), i) for i, p in enumerate(prints)], "fp long, node long")
    links = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]

    def roots(pairs):
        root = list(range(len(prints)))
        for a, b in pairs:
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if x in (ra, rb) else x for x in root]
        return root

    for most in (256, 3):
        assert roots([(r.a, r.b) for r in s.links(nodes, most).collect()]) == roots(links)
    by_table = dict((r.node, r.root) for r in s.components(s.links(nodes, 256)).collect())
    assert [by_table.get(i, i) for i in range(len(prints))] == roots(links)


def test_pivot_pairs_are_exact():
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 1 << 12, 300, dtype=np.uint64))
    i, j = s.pivot_pairs(np.zeros(len(fp), np.int64), fp)
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if int(np.bitwise_count(fp[a] ^ fp[b])) <= 3}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_drop_near_copies(spark):
    rng = random.Random(4)
    a, b = prose(rng, 300), prose(rng, 300)
    table = docs(spark, [(3, a), (1, a), (2, b), (7, None), (8, ""), (None, a), (9, b + " x")])
    kept = s.drop_near_copies(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 7]
    assert s.drop_near_copies(table.where("false")).count() == 0


def test_families_with_missing_ids_stay_apart(spark):
    rng = random.Random(6)
    a, b, c, d = (prose(rng, 200) for _ in range(4))
    rows = [(1, a), (None, a), (2, b), (None, b), (5, c), (None, d), (None, d)]
    table = docs(spark, rows)
    got = sorted(((r["doc_id"] or 0, r["component_id"]) for r in collect(s.simhash_components(table))), key=str)
    assert got == sorted([(1, 1), (0, 1), (2, 2), (0, 2), (5, 5), (0, None), (0, None)], key=str)
    assert sorted(((r.doc_id or 0, r.text) for r in s.drop_near_copies(table).collect())) == sorted([(1, a), (2, b), (5, c), (0, d)])
