"""Files that tasks write into, and read from, the shared folder."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, s3, gs, hdfs, ...) and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def attempt_name(suffix: str) -> str:
    """A file name of this attempt of this task only: a lost attempt's file is never read or overwritten."""
    task = TaskContext.get()
    at = (task.partitionId(), task.attemptNumber()) if task else (0, 0)
    return f"part-{at[0]:06d}-{at[1]}-{uuid.uuid4().hex[:8]}{suffix}"
