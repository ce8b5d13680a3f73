"""Full-text postings kept up by a stream: every micro-batch becomes one index segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import fulltext as fts


def maintain(rows: DataFrame, key: str, text: str, config: fts.FtsConfig, path: str, checkpoint: str) -> StreamingQuery:
    """Index the rows of a stream below ``path``/<batch>; a batch that is tried again replaces its own segment.

    ``fulltext.load`` reads all segments; keys must not repeat over batches. Runs until what is available is done.
    """

    def segment(batch: DataFrame, number: int) -> None:
        from ..sources.storage import Files

        where = f"{path}/{number:012d}"
        Files(batch.sparkSession).delete(where)
        fts.build(batch, key, text, config, where)

    return rows.writeStream.foreachBatch(segment).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
