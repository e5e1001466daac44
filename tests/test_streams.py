import random

from pyspark.sql import functions as F

from stackloom.operators import timeline
from stackloom.streaming import deferred as D

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "file string, cookie long, time long, ord long, is_chain boolean, frames array<bigint>"


def test_deferred_stream_equals_batch(spark, tmp_path):
    """Two files, cookies that are used again, several samples of a cookie, chains that never come or come first."""
    rng = random.Random(3)
    samples, chains, t = [], [], 0
    for k in range(240):
        t += rng.randrange(1, 30) * 1_000_000
        row = (rng.choice("ab"), k, t, rng.randrange(6))
        if rng.random() < 0.6:
            samples.append((*row, [k, k + 1]))
        else:
            chains.append((*row, [1000 + k] * rng.randrange(3)))
    s = spark.createDataFrame(samples, "file string, ord long, time long, cookie long, callchain array<bigint>")
    d = spark.createDataFrame(chains, "file string, ord long, time long, cookie long, ips array<bigint>")
    want = {(r.file, r.ord): list(r.callchain) for r in timeline.merge_deferred(s, d).collect()}
    assert 50 < len(want) < len(samples)
    rows = [tuple(r) for r in D.rows_of(s, d).select("file", "cookie", "time", "ord", "is_chain", "frames").collect()]
    rows.sort(key=lambda r: r[2] + rng.randrange(1_500_000_000))
    batches = [rows[k : k + 50] for k in range(0, len(rows), 50)] + [[("end", 0, t + 10**11 + k, k, False, [])] for k in range(2)]
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKS)
    try:
        for b in batches:
            spark.createDataFrame(b, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = D.merge_stream(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")), "2 seconds", 10**12)
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    got = spark.read.parquet(str(tmp_path / "out")).filter(F.col("file") != "end").collect()
    assert {(r.file, r.ord): list(r.callchain) for r in got} == want and len(got) == len(want)
