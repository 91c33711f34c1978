import pytest

import corpus_pipeline
from netsight.llm import decontaminate, quality
from netsight.session import cut_lineage


@pytest.fixture
def folder(spark, documents, nasty, prose, tmp_path):
    line = " ".join(w if k % 4 else "the" for k, w in enumerate(prose(80, 70).split()))
    fill = lambda n, k: " ".join(w if j % 4 else "of" for j, w in enumerate(prose(n, k).split()))
    rows = nasty + [(100 + i, fill(90 + i, 200 + i) + ".", "hot" if i % 3 else "b") for i in range(30)]
    rows += [(200, line + "\n" + fill(70, 301), "b"), (201, fill(70, 302) + "\n" + line, "b"), (202, line, "c"), (203, rows[-1][1], "c")]
    rows += [(204, rows[20][1].replace(" ka", " ka", 1), "c"), (205, fill(60, 303) + " " + prose(20, 400) + " " + fill(60, 304), "c")]
    rows += [(206, " ".join(w + "%%%" for w in prose(90, 500).split()), "b"), (207, prose(90, 501).replace(" ", " | "), "b")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(20, 400)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_stages(spark, folder):
    sf, rows = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf))
        kept[name] = docs.collect()
        assert docs.columns[: len(names)] == names
    judged = quality.judged(spark.read.parquet(f"{sf}/documents.parquet")).where("kept").collect()
    assert sorted(str(r.doc_id) for r in kept["quality_rules"]) == sorted(str(r.doc_id) for r in judged)
    assert {r.doc_id for r in kept["quality_rules"]} >= {100, 110, 200, 201, 202, 205} and not {206, 207, 3, 4, 5, 7} & {
        r.doc_id for r in kept["quality_rules"]
    }
    texts = {r.doc_id: r.text for r in kept["line_dedup"]}
    assert texts[200].count("\n") == 1 and "\n" not in texts[201] and 202 not in texts and 203 not in texts
    assert {r.doc_id for r in kept["near_dedup"]} <= set(texts)
    assert 205 in {r.doc_id for r in kept["near_dedup"]} and 205 not in {r.doc_id for r in kept["decontamination"]}
    assert all(1 <= r.copies <= 3 for r in kept["source_mix"])
    assert docs.columns == [*names, "copies"]
    ran = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, ran.collect())) == sorted(map(str, kept["source_mix"]))


def test_near_dedup_keeps_one_of_each_group(spark, documents, nasty, prose):
    text = prose(200, 5)
    rows = nasty + [(50, text, "a"), (51, text, "b"), (52, text, None), (52, text, None), (53, prose(200, 6), "a"), (None, text, "a")]
    kept = corpus_pipeline.near_dedup(spark, documents(rows), "").collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(50) == 1 and not {51, 52} & set(ids) and 53 in ids
    assert ids.count(2) == 0 and ids.count(1) == 1  # equal to document 1
    assert sum((r.text or "").strip(" \t\n\x0b\x0c\r") == "" for r in kept) == 1  # all texts without words are one group


def test_decontamination_goes_by_row(spark, documents, prose, tmp_path):
    spark.createDataFrame([(1, prose(20, 400))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "x " + prose(20, 400), "a"), (1, "clean text", "a"), (None, prose(20, 400), "b"), (None, None, "b"), (2, None, None), (2, None, None)]
    kept = corpus_pipeline.decontamination(spark, documents(rows), str(tmp_path)).collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept) == sorted(map(str, [(1, "clean text"), (None, None), (2, None), (2, None)]))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty_table(spark, documents, tmp_path, stage):
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert stage(spark, documents([]), str(tmp_path)).count() == 0


def test_stage_uses_an_operator_of_its_own():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "source_mix"]
    assert decontaminate.SEGMENT >= 1
