"""Derived indexes kept up with a log: rebuild, catch up from a checkpoint, Structured Streaming.

An index is a store of its own: each micro-batch is one segment of newest versions, so a batch costs what
it holds and not what the index holds, and reading merges them. A batch number in the manifest makes
repeats harmless.
"""

from __future__ import annotations

import json
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdoc.functions.names import validate_name
from sparkdoc.operators import entries as E
from sparkdoc.sources.objects import NotFoundError, ObjectStore
from sparkdoc.sources.store import Store, shared_folder


class EntryIndexer(Protocol):
    """Consumer of changes: ``reset`` empties it, ``apply`` takes the newest versions of changed keys (null: deleted)."""

    def reset(self) -> None: ...
    def apply(self, changes: DataFrame) -> None: ...


def _checkpoint_key(system: str) -> str:
    return f"checkpoints/{validate_name(system)}.json"


def save_checkpoint(objects: ObjectStore | None, system: str, seq: int) -> None:
    if objects is not None and system:
        objects.put(_checkpoint_key(system), json.dumps({"last_seq": seq}).encode())


def load_checkpoint(objects: ObjectStore | None, system: str) -> int:
    """The saved sequence number; 0 if there is none or it can't be read."""
    if objects is None or not system:
        return 0
    try:
        return int(json.loads(objects.get(_checkpoint_key(system)))["last_seq"])
    except (NotFoundError, ValueError, KeyError, TypeError):
        return 0


def delete_checkpoint(objects: ObjectStore | None, system: str) -> None:
    if objects is not None and system:
        objects.delete(_checkpoint_key(system))


class Builder:
    """Brings an indexer up to a store."""

    def __init__(self, store: Store, indexer: EntryIndexer, system: str, objects: ObjectStore | None) -> None:
        if store is None or indexer is None:
            raise ValueError("a builder needs a store and an indexer")
        self.store, self.indexer, self.system, self.objects = store, indexer, system, objects

    def rebuild(self) -> int:
        """Reset, apply all live entries, checkpoint at the store's newest sequence number."""
        self.indexer.reset()
        self.indexer.apply(self.store.scan())
        save_checkpoint(self.objects, self.system, self.store.last_seq)
        return self.store.last_seq

    def catch_up(self) -> int:
        """Apply what changed since the checkpoint; without one, or with one ahead of the store, rebuild."""
        since = load_checkpoint(self.objects, self.system)
        if since == 0 or since > self.store.last_seq:
            return self.rebuild()
        if since < self.store.last_seq:
            self.indexer.apply(self.store.scan_since(since).select("key", "seq", "value"))
            save_checkpoint(self.objects, self.system, self.store.last_seq)
        return self.store.last_seq


class StoreIndexer:
    """An indexer that is a store. It numbers what it applies itself, so that a rebuild is newer than what it replaces."""

    def __init__(self, index: Store) -> None:
        self.index = index

    def reset(self) -> None:
        live = self.index.scan().select("key", F.lit(None).cast(self.index.schema["value"].dataType).alias("value"))
        if self.index.manifest.segments():
            self.index.write(live)

    def apply(self, changes: DataFrame) -> None:
        self.index.write(changes.select("key", "value"))


def start(log_path: str, index: Store, checkpoint: str, files_per_batch: int = 16):
    """Follow a folder of log segments into ``index``: all that is there now, then stop; run again to follow on."""
    stream = index.spark.readStream.schema(index.schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(log_path)

    def apply(batch: DataFrame, number: int) -> None:
        index.write(E.latest(batch), batch=number)
        index.maybe_compact()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_latest(spark: SparkSession, log: DataFrame) -> DataFrame:
    """Live entries of a log that was written as segments and streamed into an index."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    log.repartition(8, "key").write.parquet(f"{root}/log")
    index = Store(spark, f"{root}/index", log.schema["value"].dataType)
    query = start(f"{root}/log", index, f"{root}/checkpoint", files_per_batch=3)
    query.awaitTermination()
    return index.scan()
