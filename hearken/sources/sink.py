"""A streaming sink into folders by run that takes each batch once, however often it is started again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from .files import Store


class RunSink:
    """Writes of one named query: a batch's files are staged, moved under names of the batch, and the batch is marked.

    A batch that comes again is left out if it is marked; if not, what it moved before is deleted first. So rows of a batch are there once,
    wherever a driver was lost. Readers never see staged files (their folder's name begins with an underscore); they may see a part of the batch
    that is being moved.
    """

    def __init__(self, path: str, name: str):
        self.path, self.name = path.rstrip("/"), name

    def write(self, batch: DataFrame, batch_id: int) -> None:
        store = Store(batch.sparkSession, self.path)
        own = f"{self.name}-{batch_id:09d}"
        staged, mark = f"{self.path}/_staged/{own}", f"{self.path}/_batches/{own}"
        if store.exists(mark):
            return
        for run in store.names(self.path):
            if run.startswith("run_id="):
                for f in store.names(f"{self.path}/{run}"):
                    if f.startswith(f"{own}-"):
                        store.delete(f"{self.path}/{run}/{f}")
        store.delete(staged)
        batch.write.partitionBy("run_id").parquet(staged)
        for run in store.names(staged):
            if run.startswith("run_id="):
                store.make(f"{self.path}/{run}")
                for k, f in enumerate(f for f in store.names(f"{staged}/{run}") if f.endswith(".parquet")):
                    store.move(f"{staged}/{run}/{f}", f"{self.path}/{run}/{own}-{k:05d}.parquet")
        self.commit(store, mark)
        store.delete(staged)

    def commit(self, store: Store, mark: str) -> None:
        store.touch(mark)


def stream_by_run(stream: DataFrame, path: str, name: str, checkpoint: str, sink: RunSink | None = None, **trigger) -> StreamingQuery:
    """Start a query that appends ``stream`` (with ``run_id``) to folders by run, each batch once over restarts from ``checkpoint``."""
    sink = sink or RunSink(path, name)
    return stream.writeStream.foreachBatch(sink.write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
