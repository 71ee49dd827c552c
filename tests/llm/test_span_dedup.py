import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.llm import span_dedup as s
from tests.llm.helpers import collect, docs, odd_rows, prose


def runs(parts):
    """Every span by trying all lengths: the shortest with enough sentences that have words, and enough words."""
    words = [p.lower().split() for p in parts]
    for i, w in enumerate(words):
        if not w:
            continue
        for j in range(i + 1, len(parts) + 1):
            inside = words[i:j]
            if inside[-1] and sum(map(bool, inside)) >= s.MIN_SENTENCES and sum(map(len, inside)) >= s.MIN_WORDS:
                yield i, j - i, " ".join(x for ws in inside for x in ws)
                break


def brute(rows):
    """Rows are documents by doc_id and text, in the order of doc_id and a hash of the text, as the operator says."""
    docs = sorted({(s.LAST_ID if i is None else i, text_hash(t or ""), t or "") for i, t in rows})
    where, gone = defaultdict(list), defaultdict(set)
    for k, (_, _, t) in enumerate(docs):
        for pos, n, key in runs(s.sentences(t)):
            where[key].append((k, pos, n))
    for places in where.values():
        first = min(places)[:2]
        for k, pos, n in places:
            if (k, pos) != first:
                gone[k] |= set(range(pos, pos + n))
    place = {(i, t): k for k, (i, _, t) in enumerate(docs)}
    out = []
    for i, t in rows:
        parts = s.sentences(t)
        cut = gone[place[s.LAST_ID if i is None else i, t or ""]]
        if cut:
            out.append((i, "".join(p for k, p in enumerate(parts) if k not in cut), len(cut)))
    return sorted(map(str, out))


def text_hash(text):
    """Spark's xxhash64 of a text, signed."""
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (h >> 63 << 64)


def cases():
    rng = random.Random(1)
    passages = [prose(rng, 70) for _ in range(5)]
    rows = odd_rows()
    for k in range(40):
        mine = [prose(rng, rng.randint(5, 60)) for _ in range(3)]
        if k % 2:
            mine.insert(rng.randint(0, 3), rng.choice(passages))
        rows.append((100 + k, " ".join(mine)))
    rows.append((300, passages[0] + "\n" + passages[0]))
    return rows, passages


def test_against_brute_force(spark):
    rows, _ = cases()
    got = collect(s.span_dedup(docs(spark, rows), changed_only=True))
    assert sorted(str((r["doc_id"], r["text"], r["n_removed"])) for r in got) == brute(rows)
    whole = s.span_dedup(docs(spark, rows))
    assert whole.count() == len(rows)
    assert sorted(r.doc_id or -1 for r in whole.where("n_removed > 0").collect()) == sorted(r["doc_id"] or -1 for r in got)
    assert all(r["first_doc_ids"] for r in got)


def test_passages_are_caught_and_clean_text_stays(spark):
    rng = random.Random(2)
    for maker in (lambda: prose(rng, 60), lambda: " ".join(prose(rng, 60).replace(".", "").replace("!", "").split())):
        passage = maker()
        clean = [(i, prose(rng, 200)) for i in range(20)]
        dirty = [(100 + i, prose(rng, 80) + " " + passage + " " + prose(rng, 80)) for i in range(10)]
        got = {r["doc_id"] for r in collect(s.span_report(docs(spark, clean + dirty)))}
        assert got == set(range(101, 110))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n。\t", max_size=400))
def test_sentences_make_up_the_text(text):
    assert "".join(s.sentences(text)) == text
    assert [(i, n) for i, n, _ in s.spans(s.sentences(text))] == [(i, n) for i, n, _ in runs(s.sentences(text))]


def test_long_sentences_are_cut_alike():
    rng = random.Random(3)
    words = prose(rng, 200).replace(".", "").replace("!", "").split()
    a, b = s.sentences(" ".join(["lead", *words])), s.sentences(" ".join(["another", "lead", "here", *words]))
    assert len(a) > 10 and a[2:] == b[-len(a[2:]) :]


def test_long_runs_of_one_character_take_no_longer_than_other_text():
    import time

    for ch in (".", " ", '"', "\n", "\t", ".\"", "!?", " .", "。", "\r", "x.y ", ".\t\t"):
        text = ch * (1_000_000 // len(ch))
        began = time.perf_counter()
        assert "".join(s.sentences(text)) == text
        assert time.perf_counter() - began < 5


def test_passages_cut_out_at_any_word_are_caught():
    """A passage of 51 or more words, begun and ended anywhere, in two strange surroundings."""
    rng = random.Random(5)
    missed = {51: 0, 60: 0, 80: 0}
    for n in missed:
        for _ in range(300):
            source = " ".join(prose(rng, 60) for _ in range(3)) if rng.random() < 0.5 else " ".join(prose(rng, 200).replace(".", "").replace("!", "").split())
            k = rng.randrange(len(source.split()) - n)
            passage = rng.choice([" ", "\t"]).join(source.split()[k : k + n])
            hashes = []
            for _ in range(2):
                host = prose(rng, 120).split()
                at = rng.randrange(len(host))
                hashes.append({h for _, _, h in s.spans(s.sentences(" ".join([*host[:at], passage, *host[at:]])))})
            missed[n] += not hashes[0] & hashes[1]
    assert missed[51] <= 6 and missed[60] <= 3 and missed[80] == 0, missed


def test_empty(spark):
    assert s.span_report(docs(spark, odd_rows()).where("false")).count() == 0


def test_rows_that_share_an_id_are_cut_on_their_own(spark):
    rng = random.Random(4)
    passage, again, unique, other = (prose(rng, 60) for _ in range(4))
    for i in (None, 7):
        rows = [(1, passage), (i, unique), (i, passage + "\n" + other), (i, again + "\nlast words"), (i, again + "\nfinal words")]
        left = {r["text"] for r in collect(s.span_dedup(docs(spark, rows)))}
        assert {passage, unique, other} <= left
        assert sum(again in t for t in left) == 1
