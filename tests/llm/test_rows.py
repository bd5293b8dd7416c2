"""Stages that decide row by row: rows that share or lack an id, null labels, names that clash."""

import corpus_pipeline

from fleetfold.llm import decontaminate, toxicity

PASSAGE = " ".join(f"item{i}" for i in range(30))
SCHEMA = "doc_id LONG, text STRING, source STRING, digest STRING, item STRING"


def test_rows_are_decontaminated_by_their_own_text(spark):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id LONG, text STRING")
    rows = [(None, "x " + PASSAGE), (None, "clean words here"), (5, PASSAGE), (5, "clean too"), (6, None), (7, ""), (8, PASSAGE.upper())]
    docs = spark.createDataFrame([(*r, "s", "d", "i") for r in rows], SCHEMA)
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text, r.digest) for r in kept.collect()) == [("5", "clean too", "d"), ("6", None, "d"), ("7", "", "d"), ("None", "clean words here", "d")]
    assert decontaminate.decontaminated(docs.limit(0), items).count() == 0 and decontaminate.decontaminated(docs, items.limit(0)).count() == len(rows)


def labelled(spark):
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, f"w{i} plain words {'vilegrim' if bad else 'gentle'} of text {i % 7}", "s", 0.25, "keep"))
        # Quality is unknown for most rows; their toxic label must teach all the same.
        labels.append((i, None if i % 3 else 1, int(bad)))
    return rows, spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT")


def test_null_labels_leave_the_other_categories_alone(spark):
    rows, labels = labelled(spark)
    docs = spark.createDataFrame([r[:3] for r in rows] + [(0, "a second text of this id", "s")], "doc_id LONG, text STRING, source STRING")
    sampled, _ = toxicity.sample(docs, labels, toxicity.given_categories())
    assert sampled.count() == 240 and sampled.filter("y[0] IS NULL").count() == 160
    got = toxicity.classify(docs, labels, toxicity.given_categories(), "toxic").collect()
    assert all(r.toxic == ("vilegrim" in r.text) for r in got if "plain" in r.text)


def test_toxicity_stage_keeps_columns_of_the_same_name(spark, tmp_path):
    rows, labels = labelled(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows + [(None, None, "s", 0.5, "keep"), (None, "", "s", 0.5, "keep")], "doc_id LONG, text STRING, source STRING, p_toxic DOUBLE, toxic STRING")
    kept = corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    found = kept.collect()
    assert {r.doc_id for r in found} == {r[0] for r in rows if "vilegrim" not in r[1]} | {None}
    assert {r.toxic for r in found} == {"keep"} and len(found) == 182
