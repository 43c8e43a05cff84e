"""Folders that tasks write files of their own format to."""

from __future__ import annotations

import pyarrow.fs


def open_folder(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder given as a path or a URI, with one slash or three after ``file:``."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(folder)
