"""STR1: every arriving pass is either scored or rejected, exactly once."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stream_scores_or_rejects_each_arrival_once(spark):
    from touchline.operators.inference import load_bundle
    from touchline.plans.q_models import _bundle
    from touchline.sources import views as V
    from touchline.sources.io import scratch, write_passes
    from touchline.streaming.score import start_scoring
    model, fitted, rowwise, feats, mapping = load_bundle(spark, _bundle(spark, SF))
    src, sink, ck = scratch(spark, "t-arrivals"), scratch(spark, "t-scored"), scratch(spark, "t-ckpt")
    passes = V.passes(spark, SF)
    write_passes(passes, src)
    start_scoring(spark, src, sink, ck, model, fitted, rowwise, feats, mapping, max_files=8).awaitTermination()
    scored = spark.read.parquet(f"{sink}/scored")
    rejects = spark.read.parquet(f"{sink}/rejects")
    assert scored.count() + rejects.count() == passes.count()
    assert scored.join(rejects, "pass_id", "inner").count() == 0
    assert rejects.where(F.col("reject_reason") != "invalid body_part").count() == 0
    lo, hi = scored.agg(F.min("probability"), F.max("probability")).first()
    assert 0.5 <= lo <= hi <= 1.0
    # a batch replayed after a failure leaves every row once
    from touchline.streaming.score import batch_writer, checked_requests
    write = batch_writer(sink, model, fitted, rowwise, feats, mapping)
    one = spark.read.schema(passes.schema).parquet(src).where("match_id = 3").select(*passes.columns)
    write(checked_requests(one), 990)
    before = spark.read.parquet(f"{sink}/scored").count()
    write(checked_requests(one), 990)
    assert before > scored.count() and spark.read.parquet(f"{sink}/scored").count() == before
    # a restart finds nothing new to process (offsets are in the checkpoint)
    start_scoring(spark, src, sink, ck, model, fitted, rowwise, feats, mapping).awaitTermination()
    assert spark.read.parquet(f"{sink}/scored").count() == before
