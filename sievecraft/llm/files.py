"""Binary files in a folder that all tasks share, by its address (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyarrow import fs


def _open(url: str) -> tuple[fs.FileSystem, str]:
    if url.startswith("file:") and not url.startswith("file://"):
        url = "file://" + url[len("file:") :]
    return fs.FileSystem.from_uri(url)


def make_folder(url: str) -> None:
    system, path = _open(url)
    system.create_dir(path, recursive=True)


@contextmanager
def written(url: str) -> Iterator[BinaryIO]:
    """A new file under a name of this attempt, which gets its real name once it is complete.

    A task that is tried again writes the same content to the same name.
    """
    system, path = _open(url)
    attempt = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(attempt) as out:
        yield out
    system.move(attempt, path)


@contextmanager
def opened(url: str) -> Iterator[BinaryIO]:
    """A file for reading from any place in it."""
    system, path = _open(url)
    with system.open_input_file(path) as source:
        yield source
