"""Plain files in a shared folder, written and read by tasks.

Paths are URIs as Spark has them (``file:``, ``hdfs:``, ``s3:`` ...); they are
opened through ``pyarrow.fs``.  A file appears under its name only when it is
complete, so a lost or repeated task leaves no half-written file behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, write: Callable) -> int:
    """``write(stream)`` into ``uri``; returns the size in bytes."""
    where, path = locate(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.part-{uuid.uuid4().hex}"
    with where.open_output_stream(part) as out:
        write(out)
        size = out.tell()
    where.move(part, path)
    return size
