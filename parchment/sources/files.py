"""Files of any store that Arrow can open, read in the task that needs them: whole, or a range at a time."""

from __future__ import annotations

from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs


def opened(path: str) -> pa.NativeFile:
    """A random-access file: a plain path is on a mount that all executors see, a URI names its store."""
    if "://" in path:
        store, at = fs.FileSystem.from_uri(path)
    else:
        store, at = fs.LocalFileSystem(), path.removeprefix("file:")
    return store.open_input_file(at)


def read(path: str) -> bytes:
    with opened(path) as f:
        return f.read()


def below(path: str, root: str) -> str:
    """``path``, or where it is relative the same below ``root``."""
    return path if "://" in path or path.startswith(("/", "file:")) else str(PurePosixPath(root) / path) if "://" not in root else f"{root.rstrip('/')}/{path}"
