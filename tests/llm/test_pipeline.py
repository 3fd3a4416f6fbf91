"""The pipeline's stages on a small table, against what each operator says of each row."""

import corpus_pipeline
from placeweave.llm import common, queries_labels, quality, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = common.read(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "toxicity", "SimHash near-dedup", "best-fit packing"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    good = common.materialise(corpus_pipeline.keep_quality(spark, docs, SF), "a")
    assert good.columns == docs.columns
    assert ids(good) == {r.id for r in quality.score(docs, queries_labels.quality_model(spark, SF)).filter("score >= 0.5").collect()}
    clean = common.materialise(corpus_pipeline.drop_toxic(spark, good, SF), "b")
    assert ids(clean) == {r.id for r in toxicity.score(good, queries_labels.toxicity_model(spark, SF)).filter("score < 0.5").collect()}
    single = common.materialise(corpus_pipeline.drop_near_duplicates(spark, clean, SF), "c")
    assert ids(single) == {r.component for r in simhash.near_duplicates(clean).collect()}
    packed = corpus_pipeline.pack(spark, single, SF)
    assert ids(packed) == ids(single) and packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0


def test_a_stage_bounds_what_a_task_holds_of_whole_texts(spark, tmp_path):
    """Row groups and decoded batches of many megabytes in every task at once did not fit a small heap."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.sha2(F.concat_ws(" ", "id", k), 512)), " ")
    docs = spark.range(0, 12_000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    clean = toxicity.filter_documents(docs, toxicity.Model({}, 1.0, 0.1, (0.0, 0.0, -8.0)))
    clean.write.parquet(path := str(tmp_path / "clean"))
    (part,) = (tmp_path / "clean").glob("*.parquet")
    found = pq.ParquetFile(part).metadata
    sizes = [found.row_group(i).total_byte_size for i in range(found.num_row_groups)]
    assert found.num_rows == 12_000 and len(sizes) > 2 and max(sizes) < 3 * common.ROW_GROUP_BYTES
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == common.READ_ROWS
