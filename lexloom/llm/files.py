"""Files in the shared folder, by pyarrow's file systems, and shards that tasks write there."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def shard_name(suffix: str) -> str:
    """A name for one attempt of one task. Only names that a successful task returned are read, so those of lost
    attempts don't count."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex[:12]}{suffix}"
