import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridspark.llm import token_count as t
from tests.llm.helpers import collect, docs, odd_rows

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(str(FILE))
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_random_unicode(library):
    rng = random.Random(1)
    alphabet = [*"  '''\n\t abcstremlvdSTREM09٣é中ä!?.,~  　́\x85\x1c<|>", "'re", "'ve", "'ll", "'s", "<|endoftext|>", "ing the", " there", "😀", "İ", "ⅷ", "²", "​", "﻿", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    assert t.merger(str(FILE)).counts(texts) == library(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    assert t.merger(str(FILE)).counts([text]) == library([text])


def test_long_runs_and_boundaries(library):
    texts = ["a" * 5000, "ab" * 3000, " " * 4000, "é" * 2000, "'" * 999, "x" * 20001 + " y", "\n" * 77, "don't " * 300, " \n" * 600 + "z", "'l" * 400]
    assert t.merger(str(FILE)).counts(texts) == library(texts)


def test_chunks_compose_alike():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 15, 3000).astype(np.uint8)
    codes[-1] = t.C_END
    state, marks = t.NEW, []
    for c in codes:
        marks.append(t.CUTS[state, c])
        state = t.NEXT[state, c]
    want = sorted({i - back for i, m in enumerate(marks) for back, bit in ((0, 1), (1, 2), (2, 4)) if m & bit})
    for chunk in (1, 2, 7, 256, 5000):
        assert t.piece_starts(codes, chunk).tolist() == want


def test_forgetting_states_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(t, "MAX_STATES", 50)
    monkeypatch.setattr(t, "MAX_PIECES", 20)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randint(1, 14))) for _ in range(30)) for _ in range(40)]
    model = t.Merger.load(str(FILE))
    assert [model.counts([x])[0] for x in texts] == library(texts)


def test_query_shape_and_odd_rows(spark, library):
    got = collect(t.token_counts(docs(spark, odd_rows()), "byte_bpe_50k.json", carry=["doc_id"]))
    want = [(i, len((x or "").encode()), n, n > 512) for (i, x), n in zip(odd_rows(), library([x or "" for _, x in odd_rows()]))]
    assert sorted(str((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"])) for r in got) == sorted(map(str, want))
    assert t.token_counts(docs(spark, odd_rows()).where("false"), str(FILE)).count() == 0


def test_states_stay_bounded_inside_one_piece(monkeypatch, library):
    monkeypatch.setattr(t, "MAX_STATES", 300)
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    model = t.Merger.load(str(FILE))
    assert model.counts([text]) == library([text])
    assert len(model.states) <= 303 and len(model.compatible) <= 4 * 300 + 100


def test_settings_that_are_not_implemented_are_refused():
    import json

    with open(FILE, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"] = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}
    t.refuse_unknown(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"truncation": {"max_length": 5}}):
        with pytest.raises(ValueError, match="implemented"):
            t.refuse_unknown(spec | change)
    for name in ("ignore_merges", "byte_fallback", "dropout"):
        with pytest.raises(ValueError, match=name):
            t.refuse_unknown(spec | {"model": spec["model"] | {name: True}})
