"""Each stage of the pipeline on its own input, held against brute force."""

import os

import pytest

import corpus_pipeline
from test_llm import WORDS, covered, linked, unlined

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """name -> (rows in, rows out) of the stages one after another."""
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.orderBy("doc_id").collect()]
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == "packing" or docs.columns == columns
        out[name] = (before, [r for r in docs.orderBy("doc_id").collect()])
    return out


def test_quality(stages, spark):
    before, after = stages["quality_classifier"]
    kept, told = {r["doc_id"] for r in after}, spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r["doc_id"] for r in told if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["doc_id"] for r in told if r["quality"] == 0]
    assert sum(i in kept for i in good) >= 0.9 * len(good) and sum(i in kept for i in bad) <= 0.5 * len(bad)
    texts = {r[0]: r[1] for r in before}
    assert all(texts[r["doc_id"]] == r["text"] for r in after)


def test_lines(stages):
    before, after = stages["line_dedup"]
    expected = {i: text for i, n, gone, text in unlined(before) if not gone or gone < n}
    assert {r["doc_id"]: r["text"] for r in after} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near(stages):
    before, after = stages["minhash_near_dedup"]
    assert [r["doc_id"] for r in after] == [i for i, _, _, kept in linked(before) if kept]


def test_near_with_null_and_shared_ids(spark):
    """A unique text stays whatever its id; a copy goes even if another row of its id is kept."""
    t, u = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(None, t), (4, t), (9, t), (9, u), (None, "all alone here"), (None, None), (3, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [tuple(r) for r in corpus_pipeline.stages.near(spark, docs, SF).collect()]
    assert sorted(out, key=str) == sorted([(4, t), (9, u), (None, "all alone here"), (None, None), (3, None), (7, None)], key=str)


def test_substrings(stages):
    before, after = stages["substring_dedup"]
    texts = {r[0]: r[1] for r in before}
    expected = {i: (kept if gone else texts[i]) for i, n, gone, kept in covered(before, 20) if not gone or gone < n}
    assert {r["doc_id"]: r["text"] for r in after} == expected
    assert any(WORDS.findall(texts[r["doc_id"]]) != WORDS.findall(r["text"]) for r in after) or len(expected) == len(before)


def test_packing(stages):
    before, after = stages["packing"]
    assert {r["doc_id"] for r in after} == {r[0] for r in before}
    for i in {r["doc_id"] for r in after}:
        own = sorted((r["start"], r["length"], r["doc_tokens"]) for r in after if r["doc_id"] == i)
        assert sum(n for _, n, _ in own) == own[0][2] and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:], strict=False))


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, __id long, __key long, kept_id string, n_removed string, n_words string, n_lines string, keep string, component_id string, id string"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_tables(spark, name, stage):
    """Columns of any name, repeated rows, null ids and texts, and no rows at all."""
    t = " ".join(f"word{i}" for i in range(40))
    rows = [(i, x, "en", "s", None if x is None else len(x), 1, 2, "a", "b", "c", "d", "e", "f", "g") for i, x in [(1, t), (1, t), (2, t + " more"), (None, t), (None, None), (3, None), (4, ""), (5, "a\nb\nc"), (6, "a\nb\nc"), (7, t[::-1])]]
    docs = spark.createDataFrame(rows, CLASHES)
    out = stage(spark, docs, SF)
    found = out.collect()
    assert stage(spark, docs.limit(0), SF).collect() == []
    if name == "packing":
        assert sorted({r["doc_id"] for r in found}, key=str) == sorted({r[0] for r in rows}, key=str) and sum(r["start"] == 0 for r in found) == len(rows)
    else:
        assert out.columns == docs.columns and all(tuple(r)[5:] == rows[0][5:] for r in found)
        assert {r["doc_id"] for r in found} >= {7} and {r["doc_id"] for r in found} <= {r[0] for r in rows}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
