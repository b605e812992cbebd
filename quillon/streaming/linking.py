"""Linking a stream of new records against a standing reference.

Each micro-batch is normalised and joined with the reference by the guarded equi-join; a batch that is repeated after a
failure replaces its own output, so every record is linked once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillon.functions import text as tx
from quillon.operators import blocking


def normalized_stream(records: DataFrame) -> DataFrame:
    """All views of a stream of records; stateless, so it needs no watermark."""
    return tx.normalized(records)


def link_stream(records: DataFrame, reference: DataFrame, path: str, checkpoint: str, view: str = "name_content", max_block: int = blocking.MAX_BLOCK, **trigger) -> StreamingQuery:
    """Writes q, r for every new record to path/batch=<n>; trigger: availableNow=True by default."""

    def link(batch: DataFrame, number: int) -> None:
        blocking.exact_block(tx.normalized(batch), reference, view, max_block).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
