"""Binary files in the shared folder, written and range-read by executors.

Spark's writers cannot write a foreign binary format, so tasks write these files
through pyarrow's filesystems (file, hdfs, s3, gs).  A file gets its final name
only when it is complete, and a name is never used twice: a task that is run
again writes new files, and only the files of the attempt whose rows were
committed to the manifest table are ever read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem and path of a URI; a bare path is a local one."""
    if "://" not in uri:
        uri = "file://" + uri
    return pafs.FileSystem.from_uri(uri)


def write_file(folder: str, suffix: str, payload: bytes) -> str:
    """Write payload under a new name in folder; returns the name's URI."""
    name = uuid.uuid4().hex + suffix
    fs, path = resolve(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/.{name}.part") as out:
        out.write(payload)
    fs.move(f"{path}/.{name}.part", f"{path}/{name}")
    return f"{folder}/{name}"


def read_file(uri: str) -> bytes:
    fs, path = resolve(uri)
    with fs.open_input_file(path) as f:
        return f.read()
