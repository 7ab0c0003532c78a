"""Files of our own formats in the shared folder, written by tasks and read as streams.

``spark.checkpoint.dir`` is a URI (file, hdfs, s3 and what else pyarrow opens). A task writes under a name of its own
attempt and moves the finished file to its final name, so a repeated or speculative attempt leaves one whole file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextmanager
def writing(uri: str) -> Iterator:
    """An output stream whose file appears at ``uri`` when the block ends well."""
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    partial = f"{path}.{uuid.uuid4().hex}.partial"
    with system.open_output_stream(partial, compression=None) as out:
        yield out
    system.move(partial, path)


def stream(uri: str):
    system, path = opened(uri)
    return system.open_input_stream(path, compression=None)


def random_access(uri: str):
    system, path = opened(uri)
    return system.open_input_file(path)
