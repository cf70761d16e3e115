"""An inbox: files that arrive in a folder are uploaded as they come."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from .. import sources
from ..engine import KnowledgeBase


def watch(base: KnowledgeBase, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Uploads each file of folder when it appears. A batch that is repeated after a failure adds nothing: its content is known.

    A file that can't be taken (too large, a format without a reader, not UTF-8) is noted in the table failure.
    """
    stream = base.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def upload(batch, _):
        base.upload_rows(sources.extracted(sources.taken(batch, base.config)))

    writer = stream.writeStream.foreachBatch(upload).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
