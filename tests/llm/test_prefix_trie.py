import hashlib
import random
import zlib

import pytest

from gridspark.llm import prefix_trie as t

TABLE = "conv_id long, turn long, role string, text string, depth int, k1 string, family string, block int, seq int, chars int, n int, ends string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "f", 2, 3, 4, 5, "e") for r in rows], TABLE).repartition(3)


def brute(rows):
    tie = lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def total(p, value):
        out, todo = 0, [p]
        while todo:
            q = todo.pop()
            out += value(q)
            todo += kids.get(q, [])
        return out

    out = []
    for p, m in members.items():
        ends = sorted(c for c in m if len(rebuilt[c]) == len(p))
        saved = total(p, lambda q: (len(members[q]) - 1) * (len(q[-1][1]) if q else 0))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), total(p, lambda q: q not in kids), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(map(str, out))


def got(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(str(tuple(r)) for r in df.select(*names).collect())


def rows(n=120, seed=1, long=60):
    rng = random.Random(seed)
    words = ["yes", "no", "", "ä" * 7, None, "a longer text of some words"]
    out = []
    for c in [*range(-130, -80), *range(-5, n), *range(300, 340), 1000, 12345]:
        for k in range(rng.choice([1, 2, 3, 4, 8])):
            out.append((c, k, rng.choice(["user", "assistant", None]), rng.choice(words)))
    out += [(7, None, "system", "null turn"), (7, 1, "user", "tie"), (7, 1, "user", "eit"), (7, 1, "user", "tie"), (None, 0, "user", "nobody"), (None, 1, "user", "nobody")]
    out += [(200, k, "user", rng.choice(words)) for k in range(long)] + [(201, k, "user", "hot") for k in range(4 * long)] + [(202, k, "user", "hot") for k in range(4 * long)] + [(203, 1, "user", "same")] * 40
    copies = [(k, "user", f"copied {k}") for k in range(9)]
    return out + [(c, *x) for c in range(5000, 5350) for x in copies]


@pytest.mark.parametrize("bits", [16, 5, 2])
def test_against_brute_force(spark, bits):
    data = rows()
    assert got(t.trie_report(table(spark, data), bits)) == brute(data)


def test_depths_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(t, "DEPTHS", 3)
    data = rows(30, 2)
    assert got(t.trie_report(table(spark, data), 4)) == brute(data)


def test_small_tables(spark):
    for data in ([(5, 0, "user", "x")], [(100, 0, "user", "x")], [(7, None, None, None)], [(3, 0, "u", "x"), (103, 0, "u", "x")]):
        assert got(t.trie_report(table(spark, data))) == brute(data)
    assert got(t.trie_report(table(spark, rows()).where("false"))) == []
    assert got(t.trie_report(table(spark, [(None, 0, "u", "x")]))) == []
