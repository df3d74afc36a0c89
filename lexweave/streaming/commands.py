"""Parse commands from a stream of ``(id, text[, region_hint])``.

Rows are independent, so there is no state and no watermark. A narrow scorer runs inside the
streaming plan; one that joins or groups runs per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexweave.plans.commands import Scorer, parse_corpus


def read_requests(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def parse_stream(
    requests: DataFrame,
    scorer: Scorer,
    output: str,
    checkpoint: str,
    narrow: bool = True,
    available_now: bool = True,
    **options,
) -> StreamingQuery:
    """Append parsed rows to Parquet files, exactly once through the stream's checkpoint.

    Per-batch writes go to a folder named after the batch, so a repeated batch replaces itself.
    """
    if narrow:
        writer = (
            parse_corpus(requests, scorer, **options)
            .writeStream.format("parquet")
            .option("path", output)
            .outputMode("append")
        )
    else:

        def write(batch: DataFrame, epoch: int) -> None:
            parsed = parse_corpus(batch, scorer, **options)
            parsed.write.mode("overwrite").parquet(f"{output}/batch={epoch}")

        writer = requests.writeStream.foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
