"""STR1: streaming scoring of arriving passes.

readStream (explicit schema) → request validation → inference frame →
pipeline model (stream–static: the fitted lookup tables are static frames) →
``foreachBatch`` writing accepted rows and rejects to two sinks.  Stateless, so
append mode needs no watermark; ``availableNow`` drains what has arrived and
stops, and the checkpoint makes a restarted job resume where it was.  Each batch
overwrites the folder of its own epoch, so a batch that is replayed after a
failure between or after the two writes leaves every row once.
"""

from __future__ import annotations

import os

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.inference import inference_frame
from touchline.operators.passes import validate_requests
from touchline.sources.io import PASS_SCHEMA


def batch_writer(sink: str, model, fitted, rowwise, features, mapping, model_name: str = "gbt"):
    """The ``foreachBatch`` function: (validated batch, epoch) → two folders."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()     # read for both sinks
        good = batch.where("is_valid").drop("is_valid", "reject_reason")
        frame = inference_frame(good, rowwise, fitted, features, mapping, keep=["pass_id"])
        scored = model.transform(frame)
        probs = vector_to_array("probability")
        out = scored.select("pass_id", (F.array_position(probs, F.array_max(probs)) - 1).cast("int")
                            .alias("prediction"), F.array_max(probs).alias("probability"),
                            F.lit(model_name).alias("model"))
        out.write.mode("overwrite").parquet(os.path.join(sink, "scored", f"epoch={epoch}"))
        batch.where(~F.col("is_valid")).select("pass_id", "reject_reason") \
            .write.mode("overwrite").parquet(os.path.join(sink, "rejects", f"epoch={epoch}"))
        batch.unpersist()

    return write


def checked_requests(passes: DataFrame) -> DataFrame:
    pressure = F.when(F.col("under_pressure"), F.lit(1)).otherwise(F.lit(0))
    return validate_requests(passes.withColumn("under_pressure", pressure))


def start_scoring(spark: SparkSession, source: str, sink: str, checkpoint: str, model, fitted, rowwise,
                  features, mapping, model_name: str = "gbt", max_files: int = 1):
    stream = spark.readStream.schema(PASS_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(source)
    write = batch_writer(sink, model, fitted, rowwise, features, mapping, model_name)
    return (checked_requests(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
