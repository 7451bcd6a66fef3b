import corpus_pipeline as P
from pyspark.sql import functions as F

from terraloom.llm.common import materialize


def test_each_stage_on_planted_rows(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    base = docs.where("lang = 'en' and n_chars between 900 and 3000").first()
    words = base.text.split()
    near = " ".join([*words[:30], "changed", *words[31:]])
    extra = [(9001, base.text), (9002, near), (9003, base.text + " " + item), (9004, "123 !!"), (9005, None), (None, base.text)]
    planted = spark.createDataFrame(extra, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    rows = materialize(docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(planted), "test-docs")

    kept = P.language_stage(spark, rows, "/root/testdata/sf0.01")
    assert kept.columns == rows.columns
    assert {9004, 9005}.isdisjoint(r.doc_id for r in kept.select("doc_id").collect())

    same = [base.doc_id, 9001, 9002, None]
    once = P.near_duplicate_stage(spark, rows, "/root/testdata/sf0.01").select("doc_id", F.md5("text").alias("h")).collect()
    assert sum(r.doc_id in same for r in once if r.doc_id != 9003) <= 1
    assert len({r.h for r in once}) == len(once)

    clean = {r.doc_id for r in P.decontamination_stage(spark, rows, "/root/testdata/sf0.01").select("doc_id").collect()}
    assert 9003 not in clean and base.doc_id in clean

    out = P.pieces_stage(spark, rows, "/root/testdata/sf0.01")
    assert out.where(F.col("n_tokens") != F.size("ids")).count() == 0
    j = out.join(rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("want")), "doc_id")
    assert j.where("want <> decoded_sha256").count() == 0
    assert [n for n, _ in P.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "pieces"]
