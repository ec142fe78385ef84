"""Manifests are parsed once a document."""

from pyspark.sql import functions as F

from pageloom.sources import manifests as N


def test_documents_are_parsed_once(spark):
    text = '{"schema_version": %d, "page": {"id": %d}, "regions": [{"region_id": "R1", "bbox": [1.0, 2.0, 3.0, 4.0]}]}'
    rows = [(1, 1, text % (2, 7)), (1, 2, text % (3, 8)), (1, 3, "no manifest"), (1, 4, None)]
    made = spark.createDataFrame(rows, "project_id long, order_index long, manifest string").withColumn("manifest", F.concat("manifest", F.lit(" ")))
    pages, regions, rejected = N.import_manifest(made)
    assert regions._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [(r.image_id, r.region_key, r.x, r.tx) for r in regions.collect()] == [(7, "R1", 1.0, 1.0)]
    assert [r.image_id for r in pages.collect()] == [7]
    assert sorted(r.order_index for r in rejected.collect()) == [2, 3, 4]
