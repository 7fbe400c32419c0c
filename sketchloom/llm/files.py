"""Files in the shared scratch folder, opened from tasks through pyarrow's file systems."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from sketchloom.session import scratch_dir


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's URI in the shared folder; tasks make it when they write to it."""
    return os.path.join(scratch_dir(spark), f"{tag}-{uuid.uuid4().hex}")


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.removeprefix("file:"))


def create(uri: str):
    """An output stream for a file that no other attempt of a task writes."""
    system, path = resolve(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path, compression=None)


def open_stream(uri: str):
    system, path = resolve(uri)
    return system.open_input_stream(path, compression=None)


def open_random(uri: str):
    system, path = resolve(uri)
    return system.open_input_file(path)


def local_path(uri: str) -> str | None:
    """The path of a file that the machine itself sees, as a shared mount; else null."""
    system, path = resolve(uri)
    return path if isinstance(system, fs.LocalFileSystem) else None
