from datetime import datetime

from pyspark.sql import functions as F

from quillwatch.operators.alerts import enrich_detections
from quillwatch.plans.store import AlertStore
from quillwatch.session import kept
from quillwatch.streaming import watch

DETECTION = (
    "event_id string, timestamp timestamp, username string, database string, "
    "source_system string, client_ip string, query string, risk_score double, severity string, "
    "classification string"
)


def detections(spark, rows):
    at = datetime(2026, 7, 20, 10)
    return spark.createDataFrame(
        [(f"e{n}", at, f"u{n % 5}", "db", "pg", None, "DROP TABLE x", 0.8, "high", "c")
         for n in range(rows)],
        DETECTION,
    )


def test_store_computes_a_batch_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        seen.add(1)
        return name

    found = detections(spark, 40).withColumn("username", counted("username"))
    batch = enrich_detections(found, batch_id="b", generated_at="2026-07-21T00:00:00Z")
    store = AlertStore(spark, str(tmp_path / "store"))
    assert store.persist_batch(batch, batch_id="b", generated_at="2026-07-21T00:00:00Z")
    assert seen.value == 40
    assert not batch.storageLevel.useMemory
    assert sorted(r.occurrence_count for r in store.state().collect()) == [8] * 5
    assert store.events().count() == 40


def test_kept_leaves_a_cache_of_the_caller(spark):
    mine = spark.range(7).withColumn("x", F.col("id") * 3).persist()
    with kept(mine):
        assert mine.count() == 7
    assert mine.storageLevel.useMemory
    mine.unpersist()


def test_one_file_is_spread_over_the_tasks(spark):
    tasks = spark.sparkContext.defaultParallelism
    rows = spark.range(1_000).coalesce(1)
    wide = watch.spread(rows)
    assert wide.rdd.getNumPartitions() == tasks
    assert sorted(r.id for r in wide.collect()) == list(range(1_000))
    many = spark.range(0, 1_000, 1, tasks + 1)
    assert watch.spread(many).rdd.getNumPartitions() == tasks + 1
