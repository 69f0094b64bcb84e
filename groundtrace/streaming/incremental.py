"""Assessment of a growing stream of samples, an extension of the batch engine.

Every micro-batch adds its samples to a table; the tracks that it touches are assessed again as a whole, as
a later sample may lengthen a part but never changes what lies before. Nothing is split by time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from groundtrace.operators.quality import Policy
from groundtrace.plans.assessment import Assessment


def assess_stream(samples: DataFrame, targets: DataFrame, policy: Policy, table: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Starts a query over streaming ``samples``. ``table`` is the folder that gathers them, partitioned by batch, so that a batch that runs twice is written once.

    ``sink`` gets the relations of the touched tracks and the number of the batch.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        gathered = spark.read.schema(samples.schema).option("recursiveFileLookup", True).parquet(table)
        touched = spark.read.schema(samples.schema).parquet(f"{table}/batch={number}").select("track_id").distinct()
        assessed = Assessment(gathered.join(touched, "track_id", "left_semi"), targets, policy)
        sink(assessed.relations, number)
        assessed.judged.unpersist()

    return samples.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
