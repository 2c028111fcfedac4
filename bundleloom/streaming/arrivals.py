"""Extension: optimize files as they arrive, with Structured Streaming.

Payload rows of a streaming table (rel, ordinal, data, error) go through the same transforms as a batch;
each micro-batch is written as Parquet, so a restart from the checkpoint repeats no finished batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from bundleloom.operators.optimize import optimize
from bundleloom.options import Options


def optimize_stream(files: DataFrame, out: str, checkpoint: str, o: Options = Options(), once: bool = True) -> StreamingQuery:
    """Start the stream; with ``once`` it stops when what is there has been worked off."""

    def batch(df: DataFrame, epoch: int) -> None:
        optimize(df, o).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
