"""Large documents, cut and put together again."""

import json
import os

from terraloom.sources import collections as Sc
from terraloom.sources.storage import shared_path


def save(spark, text, name="document"):
    path = shared_path(spark, name).removeprefix("file://")
    os.makedirs(path)
    with open(f"{path}/one.json", "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_features_of_a_document_in_ranges(spark):
    odd = ['}', '"}', "\\", '\\"}', "{[", "]}", 'é "features": [{', "", "\n}{"]
    features = [{"type": "Feature", "id": k, "properties": {"name": odd[k % len(odd)], "tags": [{"a": [1, {}]}, "]"]}, "geometry": {"type": "Point", "coordinates": [k % 90, 1]}} for k in range(500)]
    document = {"type": "FeatureCollection", "name": 'x "features": [ }', "links": [{"features": [{"id": -1}]}, {"id": -2}], "features": features, "tail": [{"id": -3}], "end": {"a": {}}}
    for indent in (None, 1):
        path = save(spark, json.dumps(document, indent=indent, ensure_ascii=False))
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # many ranges of one file
        try:
            got = Sc.features(spark, path).orderBy("place").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert [json.loads(r.text) for r in got] == features


def test_documents_without_features(spark):
    for text in ('{"type": "FeatureCollection", "features": [], "other": [{"id": 1}]}', "{}", "", '{"other": [{"features": [{}]}]}', '{"features": [ ] }'):
        assert Sc.features(spark, save(spark, text)).count() == 0
    path = save(spark, '{"features":[{"type":"Feature","id":1,"geometry":null},{"type":"Other"}, 7, {"type":"Feature","id":2,"geometry":{"type":"Point","coordinates":[500,0]}}]}')
    assert sorted((r.id, r.valid) for r in Sc.feature_collection(spark, path).collect() if r.id) == [("1", True), ("2", False)]
