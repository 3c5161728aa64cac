"""The audit as a stream: new batch files are answered as they come, and a checkpoint makes the run resumable.

Each prompt row is a batch of its own, so no state is kept between micro-batches; what was answered before a stop is not asked again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import AuditConfig
from ..operators import audit as A

PROMPTS = "split string, batch_index int, size int, row_ids array<long>, prompt string"


def answer_stream(spark: SparkSession, prompts_dir: str, out_dir: str, checkpoint: str, generate: Callable[[str], str], config: AuditConfig = AuditConfig(), files_per_trigger: int = 16) -> StreamingQuery:
    """Answers the prompt files of a folder and appends validated attempts; ends when all files present are done."""
    prompts = spark.readStream.schema(PROMPTS).option("maxFilesPerTrigger", files_per_trigger).parquet(prompts_dir)

    def answer(batch: DataFrame, batch_id: int) -> None:
        # A micro-batch that is tried again overwrites its own folder, so attempts never count twice.
        A.validate(A.ask(batch, generate, config)).write.mode("overwrite").parquet(f"{out_dir}/part={batch_id}")

    return prompts.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
