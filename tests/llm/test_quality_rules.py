import itertools
import random
import re
from collections import Counter

import pytest

from gridspark.llm import quality_rules as q
from tests.llm.helpers import collect, docs, odd_rows, prose


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        dups += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), failed


def test_base_counts(spark):
    rng = random.Random(1)
    rows = odd_rows()
    for i in range(100, 160):
        few = [rng.choice(["a", "b", "c\n", "#d", "é|"]) for _ in range(rng.randint(0, 60))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(few)))
    got = q.quality_rules(docs(spark, rows), q.DEFAULT, carry=["doc_id", "source"])
    want = sorted(str((i, *brute(t))) for i, t in rows)
    assert sorted(str((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in collect(got)) == want
    assert all(not (r["base_failed"] and r["kept"]) for r in collect(got))


def test_repeats_with_a_large_vocabulary():
    rng = random.Random(2)
    words = [f"w{i}".encode() for i in range(9000)]
    rng.shuffle(words)
    assert q.repeated_words(words + words[100:110]) == 20
    assert q.repeated_words(words) == 0
    assert q.repeated_words([b"a"] * 7) == 7


def test_viterbi_is_the_best_path():
    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.uniform(-2, 2) for _ in range(rng.randint(1, 8))]
        t = tuple(tuple(rng.uniform(-1, 1) for _ in range(2)) for _ in range(2))

        def value(path):
            return sum(s * z for s, z in zip(scores, path)) + sum(t[a][b] for a, b in zip(path, path[1:]))

        best = max(map(value, itertools.product((0, 1), repeat=len(scores))))
        assert value(q.viterbi(scores, t)) == pytest.approx(best)
    assert q.viterbi([], q.DEFAULT.transition) == []


def test_fit_separates_and_empty(spark):
    rng = random.Random(4)
    good = [(i, prose(rng, 120)) for i in range(60)]
    bad = [(100 + i, prose(rng, 60).upper().replace(" ", "!! ") + "\n" + "### $$$ &&& " * 8) for i in range(60)]
    table = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, 1 if i < 100 else 0) for i, _ in good + bad], "doc_id long, quality int")
    model = q.fit_line_crf(table, labels)
    assert model != q.DEFAULT and model == q.fit_line_crf(table, labels)
    kept = {r["doc_id"] for r in collect(q.quality_rules(table, model)) if r["kept"]}
    assert len(kept & {i for i, _ in good}) >= 58 and not kept & {i for i, _ in bad}
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.fit_line_crf(table, none) == q.DEFAULT
    assert q.quality_rules(docs(spark, [(1, "x")]).where("false"), model).count() == 0


def test_long_documents_take_part_in_the_fit():
    assert q.windows([1] * 64) == [[1] * 64]
    assert [len(w) for w in q.windows(list(range(130)))] == [64, 64, 2]
    many = q.windows(list(range(100_000)))
    assert len(many) == q.FIT_WINDOWS and all(len(w) == q.FIT_LINES for w in many)
    assert many[0][0] == 0 and many[-1][-1] == 99_999
    assert q.windows([]) == []


def brute_features(lines):
    """The names of the features that each line has, by regular expressions over text."""
    out = []
    for i, line in enumerate(lines):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        n, size = len(words), len(line.encode())
        if not n:
            out.append({"no_word"})
            continue
        count = lambda pattern: len(re.findall(pattern, line, re.ASCII))
        doubled = sum(a == b for a, b in zip(words, words[1:]))
        found = {
            "few_words": n < 3, "many_words": n >= 8, "mostly_upper": count("[A-Z]") > 0.5 * count("[A-Za-z]"), "some_upper": count("[A-Z]") > 0.2 * count("[A-Za-z]"), "symbols_5": count(r"[#*$%&|<>]") * 20 > size,
            "symbols_15": count(r"[#*$%&|<>]") * 20 > 3 * size, "shouting": 2 * count("!") > n, "bars": 4 * line.count("|") > n, "word_repeats": doubled > 0, "many_repeats": 3 * len(set(words)) < n or 4 * doubled > n,
            "line_repeats": line in lines[:i], "ends_sentence": words[-1][-1] in '.!?"', "starts_upper": bool(re.match("[A-Z]", words[0])), "digits": 10 * count("[0-9]") > size, "markup": "</" in line, "long_words": size > 14 * n,
        }
        out.append({k for k, on in found.items() if on})
    return out


def test_verdict_of_whole_texts(spark):
    """Features, the best path by trying all, the share of content and the verdict, without the operator's helpers."""
    rng = random.Random(7)
    samples = ["BUY NOW!!! $$$ ### &&&", "An ordinary sentence that simply goes on for a while.", "| a | b | c |", "</div></p>", "again again again again", "2021 2022 2023 100%", "Short", "", "Wellformed prose ends here, as one would expect of it.", "pneumonoultramicroscopic supercalifragilistic"]
    rows = [(i, "\n".join(rng.choice(samples) for _ in range(rng.randint(1, 9)))) for i in range(120)]
    model = q.LineCrf(tuple(rng.uniform(-2, 2) for _ in q.FEATURES), 0.3, ((0.5, -0.4), (-0.3, 0.6)))
    got = {r["doc_id"]: r for r in collect(q.quality_rules(docs(spark, rows), model))}
    for i, text in rows:
        lines = text.split("\n")
        scores = [model.bias + sum(w for name, w in zip(q.FEATURES, model.emission) if name in have) for have in brute_features(lines)]
        value = lambda path: sum(s * z for s, z in zip(scores, path)) + sum(model.transition[a][b] for a, b in zip(path, path[1:]))  # noqa: E731,B023
        path = max(itertools.product((0, 1), repeat=len(lines)), key=value)
        size = [len(x.encode()) - x.count(" ") for x in lines]
        share = sum(n for n, z in zip(size, path) if z) / sum(size) if sum(size) else 0.0
        assert got[i]["content_share"] == pytest.approx(share) and got[i]["n_content_lines"] == sum(path)
        assert got[i]["kept"] == (not brute(text)[5] and share >= q.MIN_CONTENT_SHARE)


def test_excerpts_of_long_texts_reach_from_start_to_end(spark):
    long = "".join(f"{i:05d}\n" for i in range(2000))
    table = spark.createDataFrame([("short",), ("x" * 800,), (long,)], "text string")
    short, exact, cut = (r.e for r in table.select(q.excerpt(q.F.col("text"), 800).alias("e")).collect())
    assert (short, exact) == ("short", "x" * 800)
    assert len(cut) == 807 and cut.startswith(long[:100]) and cut.endswith(long[-100:])
    assert all(piece in long for piece in (cut[k * 101 : k * 101 + 100] for k in range(8)))
