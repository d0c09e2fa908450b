"""Files that executors write and read in the shared folder, wherever it is."""

from __future__ import annotations

import uuid

from pyarrow import fs


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file, s3, gs, hdfs, ...) and the path in it."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.LocalFileSystem(), path


def new_file(folder: str, part: int, suffix: str) -> str:
    """A name of its own for one attempt at one part: a repeated or lost task leaves a file that no manifest names."""
    return f"{folder}/part-{part:06d}-{uuid.uuid4().hex}{suffix}"


def create(path: str):
    """An output stream, its folder made if need be."""
    system, inside = filesystem(path)
    system.create_dir(inside.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inside, compression=None)


def open_file(path: str):
    """A seekable input file."""
    system, inside = filesystem(path)
    return system.open_input_file(inside)
