"""Each stream job gives the rows of its batch twin."""

from pyspark.sql import functions as F

from pageloom.plans import streams as P
from pageloom.plans.bindings import Tables
from pageloom.streaming import jobs as J
from tests.conftest import SMALL


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()]


def stream(spark, tmp_path, df, name):
    folder = str(tmp_path / name)
    df.orderBy("event_id").coalesce(1).write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def same(spark, tmp_path, name, columns, live, twin):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    df = Tables(spark, SMALL).events_log.selectExpr(*columns)
    assert sorted(run(spark, live(stream(spark, tmp_path, df, name)), name)) == sorted(tuple(r) for r in twin(df).collect())


def test_status_changes(spark, tmp_path):
    same(spark, tmp_path, "k01", P._TASK, J.status_changes, lambda d: J.status_changes_batch(d, F.floor(F.col("event_id") / 64)))


def test_idempotent_ops(spark, tmp_path):
    same(spark, tmp_path, "k04", P._OPS, J.idempotent_ops, J.idempotent_ops_batch)


def test_fence_late(spark, tmp_path):
    same(spark, tmp_path, "k05", [c.replace("//", "div") for c in P._RES], J.fence_late, J.fence_late_batch)


def test_checkpoint_reuse(spark, tmp_path):
    same(spark, tmp_path, "k10", P._CLAIM, J.checkpoint_reuse, J.checkpoint_reuse_batch)


def test_assemble_stream(spark, tmp_path):
    texts = Tables(spark, SMALL).page_texts
    n = texts.groupBy("image_id").agg(F.count(F.lit(1)).alias("expected"))
    df = texts.join(n, "image_id").selectExpr("image_id as region_id", "reading_order as chunk_index", "text", "expected", "reading_order as event_id")
    got = run(spark, J.assemble_stream(stream(spark, tmp_path, df, "k06")), "k06")
    want = df.groupBy("region_id").agg(F.count(F.lit(1)), F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("chunk_index", "text"))), lambda v: v["text"]), "")).collect()
    assert sorted(got) == sorted(tuple(r) for r in want)


def test_windows(spark, tmp_path):
    t = Tables(spark, SMALL)
    df = P._samples(t).withColumn("event_id", F.unix_micros("ts"))
    live = run(spark, J.stage_latency(stream(spark, tmp_path, df, "k02"), "1 hour"), "k02", "complete")
    twin = [tuple(r) for r in J.stage_latency(df, "1 hour", None).collect()]
    key = lambda r: (r[0], r[1])
    assert [(r[:3], round(r[4], 9)) for r in sorted(live, key=key)] == [(r[:3], round(r[4], 9)) for r in sorted(twin, key=key)]
