import random

import numpy as np
import pyarrow as pa

from gridspark.llm import simhash as s
from tests.llm.helpers import docs, words


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"changed{rng.random()}"
    return " ".join(w)


def test_recall_against_brute_force(spark):
    """Pairs from 0.7 on, a few words changed: what stays is what brute force leaves."""
    rng = random.Random(1)
    rows = []
    for i in range(250):
        base = " ".join(words(rng, 200))
        rows += [(2 * i, base), (2 * i + 1, edited(rng, base, rng.randint(1, 6)))]
    similarity = [len(a & b) / len(a | b) for a, b in ((shingles(rows[2 * i][1]), shingles(rows[2 * i + 1][1])) for i in range(250))]
    want = {i for i, _ in rows} - {2 * i + 1 for i, x in enumerate(similarity) if x >= 0.8}
    assert 100 < len(rows) - len(want) < 240
    assert {r.doc_id for r in s.drop_near_copies(docs(spark, rows)).collect()} == want


def test_chains_in_a_crowded_bucket(spark):
    """Each copy is similar to the one before it, the ends are not; and a crowd around one text."""
    rng = random.Random(2)
    chain = [" ".join(words(rng, 200))]
    for _ in range(30):
        chain.append(edited(rng, chain[-1], 2))
    crowd = " ".join(words(rng, 200))
    rows = list(enumerate(chain)) + [(1000 + i, edited(rng, crowd, 3)) for i in range(200)]
    assert len(shingles(chain[0]) & shingles(chain[-1])) < 0.5 * len(shingles(chain[0]))
    assert {r.doc_id for r in s.drop_near_copies(docs(spark, rows)).collect()} == firsts(rows)


def firsts(rows):
    """The smallest id of each component of pairs at 0.8 or more, by brute force."""
    root = {i: i for i, _ in rows}
    sets = {i: shingles(t) for i, t in rows}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and root[i] != root[j] and len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return {i for i, r in root.items() if i == r}


def test_family_that_is_only_partly_similar(spark):
    """Copies of one text, most of them too different from one another; small cells, so that buckets are cut into parts."""
    rng = random.Random(4)
    base = " ".join(words(rng, 150))
    rows = [(i, edited(rng, base, rng.randint(1, 14))) for i in range(160)] + [(500 + i, " ".join(words(rng, 150))) for i in range(20)]
    keyed = s.row_keys(docs(spark, rows))
    want = firsts(rows)
    assert 40 < len(want) < 170
    for cell_rows in (s.CELL_ROWS, 16):
        found = {}
        for r in s.near_components(keyed, cell_rows).collect():
            found.setdefault(r.root, []).append(r.id)
        assert {min(x) for x in found.values()} == want


def test_rows_without_an_id_are_distinct(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(words(rng, 100)) for _ in range(3))
    rows = [(5, a), (None, a), (7, b), (None, b), (None, c), (None, c), (9, "other words under one id"), (9, "and more of the same id"), (9, "and more of the same id")]
    left = [(r.doc_id, r.text) for r in s.drop_near_copies(docs(spark, rows)).collect()]
    assert sorted(map(str, left)) == sorted(map(str, [(5, a), (7, b), (None, c), *rows[6:8]]))


def test_similar_sets_link_by_fingerprints_and_others_by_the_pivot_table_do_not():
    """The fingerprint and pivot table decide: sets at 0.8, of any size, link; sets at 0.5 are discarded, most by pivots' bits."""
    rng = np.random.default_rng(5)
    for size in (4, 5, 12, 20, 60, 400):
        for share, most in ((0.8, 1.0), (0.5, 0.01)):
            linked, pairs = 0, 200
            for _ in range(pairs):
                both = round(2 * size * share / (1 + share) + (0.499 if share == 0.8 else 0))
                h = rng.integers(0, 2**64 - 1, 2 * size - both, np.uint64)
                prints = np.stack([s.near_print(h[:size]), s.near_print(h[size - both :])])
                linked += len(s.linked_prints(prints, s.pivot_table(prints), np.array([size, size]), 0, np.array([1])))
            assert linked == pairs if most == 1.0 else size < 60 or linked <= most * pairs, (size, share, linked)


def test_verified_pairs_are_linked_by_fingerprints():
    """A pair whose fingerprints don't link is none, whatever its shingles: there is no way around them."""
    rng = random.Random(6)
    base = " ".join(words(rng, 200))
    x, y = base, edited(rng, base, 2)
    batch = next(s._signed(iter([pa.RecordBatch.from_pydict({"node": [1, 2], "text": [x, y]})])))
    a, b = batch.column("sig").to_pylist()
    n = batch.column("n").to_pylist()
    pair = lambda sig: pa.RecordBatch.from_pydict({"a": [1], "b": [2], "text_a": [x], "text_b": [y], "n_a": [n[0]], "n_b": [n[1]], "sig_a": [a], "sig_b": [sig]})
    assert [r.num_rows for r in s._similar(iter([pair(b)]))] == [1]
    assert [r.num_rows for r in s._similar(iter([pair(bytes(255 - v for v in b))]))] == [0]
