"""The streaming roll-up equals the batch roll-up on the same CSV parts."""

import tempfile

from areascope.operators import clean as CL
from areascope.sources import scan_feed
from areascope.sources import testdata as TD
from areascope.streaming import monthly_rollup_stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="areascope-stream-")
    feed_dir = f"{base}/bio"
    TD.bio_feed(spark, SF).repartition(3).write.option("header", True).csv(feed_dir)
    valid = TD.valid_states(spark, SF)
    batch_daily = CL.standardise_feed(scan_feed(spark, feed_dir, "bio"), "bio", valid)
    ms = CL.measures_of("bio")
    caps = batch_daily.agg(*[CL.F.percentile(CL.F.col(m), CL.F.lit(0.99)).alias(m) for m in ms]).first().asDict()
    batch = CL.quality_metrics(CL.rollup_period(CL.cap_at_percentile(batch_daily, ms), ms), ms)
    stream = monthly_rollup_stream(spark, feed_dir, "bio", caps, valid, max_files_per_trigger=1)
    q = (stream.writeStream.outputMode("complete").format("memory").queryName("bio_monthly_stream")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.table("bio_monthly_stream")
    cols = batch.columns
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, batch.collect()))
