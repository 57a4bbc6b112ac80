"""The pipeline on a small corpus: each stage's decisions take effect."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ionquarry.llm import mixing, simhash


def corpus(spark, folder):
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(f"w{int(x)}" for x in rng.integers(0, 3000, n))
    rows = [(i, text(int(rng.integers(20, 400)))) for i in range(150)]
    labels = [(i, 0, int(i % 3 == 0)) for i in range(90)]
    rows = [(i, f"{t} vile awful" if i % 3 == 0 and i < 120 else t) for i, t in rows]
    rows += [(200, rows[1][1]), (201, rows[1][1].replace(" ", "  ")), (202, None), (203, ""), (1, rows[1][1])]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    by_name = dict(corpus_pipeline.STAGES)
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == names, name
        out.write.parquet(f"{folder}/{len(seen)}")
        docs = spark.read.parquet(f"{folder}/{len(seen)}")
        seen.append(docs.count())
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            assert not ids & set(range(0, 90, 3)) and {1, 2, 200, 201, 202, 203} <= ids
        if name == "exact dedup":
            assert 201 in ids and not ids & {1, 200} and len(ids & {202, 203}) == 1
    assert seen[4] != seen[3]
    pieces = by_name["packing"](spark, docs, folder)
    per_document = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    times = docs.groupBy("doc_id").count()
    assert per_document.join(times, "doc_id").where("n <> m * count").count() == 0
    assert corpus_pipeline.run(spark, folder).count() == pieces.count()


def test_near_copies_go(spark):
    base = " ".join(f"w{i}" for i in range(5000))
    rows = [(5, base), (9, base + " more"), (7, "some other text that stands alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    assert sorted(r.doc_id for r in simhash.near_dedup(docs).collect()) == [5, 7]
    assert mixing.mix(docs).count() > 0


def test_awkward_rows(spark, tmp_path):
    """Null, repeated and blank rows, columns that clash with the stages' own, and nothing at all."""
    folder = f"file://{tmp_path}"
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{int(x)}" for x in rng.integers(0, 3000, n))
    long = text(300)
    rows = [(i, text(40), "a") for i in range(40)] + [(None, text(40), None), (None, None, None), (None, "", "a"), (60, " ", "b")]
    rows += [(70, long, "b"), (70, long, "b"), (None, long, "b"), (71, long.replace("w1", "v1"), "b"), (72, f"{long} end", None), (73, text(6000), "b")]
    names = "doc_id long, text string, source string, __row long, row string, doc string, n long, size long, run int, score double"
    docs = spark.createDataFrame([(*r, 9, "x", None, 1, 2, 3, 0.5) for r in rows], names).repartition(3)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i % 30, i % 2) for i in range(35)] + [(None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[1:4]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        found[name] = [tuple(r) for r in docs.collect()]
        assert all(r[3:] == (9, "x", None, 1, 2, 3, 0.5) for r in found[name])
    exact = [r[:2] for r in found["exact dedup"]]
    assert len(exact) == len({"".join((r[1] or "").split()) for r in rows}) and (70, long) in exact
    near = [r[0] for r in found["SimHash near-dedup"]]
    assert len([i for i in near if i in (70, 72)]) == 1 and 73 in near and set(range(40)) <= set(near)
    pieces = corpus_pipeline.run(spark, folder)
    assert pieces.count() > 0 and pieces.where("length <= 0").count() == 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{folder}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
