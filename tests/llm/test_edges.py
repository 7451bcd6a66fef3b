"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names, for every operator and stage."""

import corpus_pipeline as P
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from terraloom.llm import decontaminate, language, licenses, pieces, quality, simhash, token_file

CLASHING = ["score", "predicted", "lang_pred", "ids", "decoded", "own", "t", "range", "m", "item", "sketch", "node", "key", "label", "a", "b", "_i0", "_k0", "_o0", "_id", "_m", "_h", "lang_found", "lang_score", "quality_score", "quality_good", "row_number", "component_id"]
LONG = "the tion " * 120_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "the quick brown fox. the end"), (2, None), (3, ""), (4, " \t\n"), (None, "a null id"), (5, "twice"), (5, "twice"), (6, LONG), (7, "12 !! ²")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit("x") for c in CLASHING}).repartition(3)


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


ALL = [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (False, 5), (False, 6), (False, 7), (True, 0)]


def test_classifiers(spark, docs):
    labels = spark.createDataFrame([(1, 1, "x"), (6, 0, "x"), (None, 1, "x"), (5, 1, "x"), (5, 0, "x"), (7, None, "x")], "doc_id long, quality int, score string")
    model = quality.fit(docs, labels, F.lit(True))
    for m in (model, None):
        out = quality.score(docs, m)
        assert ids(out) == ALL and out.columns == ["doc_id", "score", "predicted"]
        assert all(0 <= r.score <= 1 for r in out.collect())
    model = language.fit(docs, F.lit(True), rounds=3)
    out = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert out[2] == out[3] == out[4] == out[7] == "und" and out[1] == out[6] == out[None] == "en"
    none = docs.limit(0)
    assert language.fit(none, F.lit(True)) is None and quality.fit(none, labels, F.lit(True)) is None
    assert quality.score(none, None).count() == language.identify(none, None).count() == 0


def test_pieces_and_token_files(docs):
    model = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.decode(pieces.encode(docs, model), model)
    assert ids(out) == ALL and {r.doc_id: r.decoded for r in out.where("doc_id <> 5").collect()}[6] == LONG
    files = token_file.read(token_file.write(docs, public_tokenizers.path("byte_bpe_50k.json"), 2))
    assert ids(files) == ALL and {r.doc_id: r.n_tokens for r in files.where("doc_id in (2, 3)").collect()} == {2: 1, 3: 1}
    assert pieces.decode(pieces.encode(docs.limit(0), model), model).count() == 0


def test_overlaps_and_licenses(spark, docs):
    mit = licenses.TEMPLATES[2][2]
    more = docs.withColumn("text", F.when(F.col("doc_id") == 6, F.concat("text", F.lit(mit))).otherwise(F.col("text")))
    assert {(r.doc_id, r.license) for r in licenses.scan(more).collect()} == {(6, "MIT")}
    items = spark.createDataFrame([(1, mit, "x"), (2, None, "x"), (3, "", "x")], "item_id long, text string, doc_id string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(more, items).collect()} == {(6, 1)}
    kept = decontaminate.clean(more, items)
    assert kept.columns == docs.columns and ids(kept) == [x for x in ALL if x[1] != 6]


def test_near_duplicates(docs):
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert out[2] == out[3] == out[4] == 2 and out[5] == 5 and out[6] == 6
    assert ids(simhash.near_duplicates(docs)) == ALL


def test_stages_keep_columns_and_take_all_rows(spark, docs, sf_dir):
    for stage in (P.language_stage, P.quality_stage, P.near_duplicate_stage, P.decontamination_stage):
        for rows in (docs, docs.limit(0)):
            assert stage(spark, rows, sf_dir).columns == docs.columns
    once = P.near_duplicate_stage(spark, docs, sf_dir)
    assert [x for x in ids(once) if x[1] in (5, 6, 7)] == [(False, 5), (False, 6), (False, 7)] and sum(x[1] in (2, 3, 4) for x in ids(once)) == 1
    out = P.pieces_stage(spark, docs, sf_dir)
    assert ids(out) == ALL


def test_quality_stage_decides_as_the_classifier_does(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"), F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    want = sorted(r.doc_id for r in quality.score(docs, model).where("score >= 0.5").collect())
    assert sorted(r.doc_id for r in P.quality_stage(spark, docs, d).select("doc_id").collect()) == want and 0 < len(want) < docs.count()
