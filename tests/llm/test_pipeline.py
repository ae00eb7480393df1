import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_jaccard_join import brute as near_groups  # noqa: E402
from tests.llm.test_line_dedup import brute as line_drops  # noqa: E402
from twinleaf.llm import decontamination  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_are_five_and_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_quality_keeps_good_documents(spark, docs):
    kept = {r.doc_id for r in corpus_pipeline.quality_filter(spark, docs, SF).collect()}
    marks = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good, bad = ([r.doc_id in kept for r in marks if r.quality == y] for y in (1, 0))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.4


def test_line_stage_against_brute_force(spark, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(rows, (t for _, _, t in line_drops(rows.values(), 10)), strict=True))
    got = corpus_pipeline.line_dedup_stage(spark, docs, SF)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_near_stage_against_brute_force(spark, docs):
    want = {d for d, n, c in near_groups([(r.doc_id, r.text) for r in docs.collect()]) if d == c or not n}
    assert {str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == want


def test_decontamination_stage_leaves_no_passage(spark, docs):
    out = corpus_pipeline.decontaminate(spark, docs, SF)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    before, after = ({r.doc_id: r.n_hit for r in decontamination.digest(x, bench).collect()} for x in (docs, out))
    assert out.columns == docs.columns and sum(before.values()) > 0 and sum(after.values()) == 0
    assert all(d in after for d, n in before.items() if n == 0)


@pytest.mark.parametrize("name", ["line_dedup", "near_dedup", "decontamination", "quality"])
def test_stages_on_awkward_tables(spark, awkward, clashing, nothing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for rows in (awkward, clashing, nothing):
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns
        out.count()


def test_run_packs_what_is_left(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0
