import corpus_pipeline
import pytest

from gridspark.llm import decontaminate, line_dedup, quality_rules, simhash
from tests.llm import helpers, test_line_dedup
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_near_copies import firsts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage got and gave, over the smoke tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        done = spark.read.parquet(path)
        out.append((name, docs, done))
        docs = done
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_in_order(spark, steps):
    assert [n for n, _, _ in steps] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "mixing"]
    assert all(done.columns == docs.columns for _, docs, done in steps[:-1])


def test_quality_stage(spark, steps):
    _, docs, done = steps[0]
    model = quality_rules.fit_line_crf(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = quality_rules.emissions(model)
    assert set(texts(done)) == {i for i, t in texts(docs).items() if quality_rules.judge(t, scores, model)[-1]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in texts(done) for i in good) > 0.9 * len(good)


def test_line_stage(steps):
    _, docs, done = steps[1]
    before = texts(docs)
    first = {}
    for i in sorted(before):
        for line in before[i].split("\n"):
            first.setdefault(line.strip(test_line_dedup.SPACE).translate(test_line_dedup.LOW), i)
    key = lambda x: x.strip(test_line_dedup.SPACE).translate(test_line_dedup.LOW)
    want = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < line_dedup.MIN_KEY or first[key(x)] == i) for i, t in before.items()}
    assert texts(done) == {i: t for i, t in want.items() if t.strip(test_line_dedup.SPACE)}


def test_near_copies_and_leaks(spark, steps):
    assert set(texts(steps[2][2])) == firsts(sorted(texts(steps[2][1]).items()))
    before = sorted(texts(steps[3][1]).items())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(texts(steps[3][2])) == {i for i, _ in before} - {i for i, _ in leaks(before, items)}


def test_odd_rows_at_every_stage(spark, tmp_path):
    """Null and repeated ids and texts, empty and long texts, further columns with clashing names; and empty tables."""
    prose = [t for i, t in helpers.odd_rows() if i == 8][0]
    rows = [*helpers.odd_rows(), (None, prose), (None, prose), (20, prose + "\nand a last line of its own, which is here"), (None, "Something else altogether, with words enough to be judged by itself.")]
    docs = helpers.docs(spark, rows, lambda k: None if k % 4 == 0 else f"s{k % 3}")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        done = spark.read.parquet(path)
        assert done.columns[: len(docs.columns)] == docs.columns or name == "mixing" and set(docs.columns) < set(done.columns)
        assert stage(spark, docs.where("false"), SF).count() == 0
        given, left = [(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.text) for r in done.collect()]
        if name == "quality_rules":
            assert set(left) < set(given) and all(t and len(t.split()) >= 10 for _, t in left)
        if name == "near_dedup":
            assert len(set(left)) == len(left) and set(left) <= set(given)
        if name == "decontamination":
            assert sorted(map(str, left)) == sorted(map(str, given))  # none holds a benchmark item
        assert done.select("key", "ranges").distinct().count() <= 1  # carried through
        docs = done


def test_nothing_stays_but_the_result(spark):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir()) if shared.exists() else set()
    corpus_pipeline.run(spark, SF)
    (new,) = set(shared.iterdir()) - before
    assert [p.name for p in new.iterdir()] == ["mixing"]


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, steps[-1][2].collect()))
    assert decontaminate.SHINGLE == 5 and simhash.MAX_BITS == 3
