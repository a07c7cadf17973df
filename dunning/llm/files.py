"""Binary files in the shared folder, written and read inside tasks.

Spark has no writer for raw bytes.  A task writes to a name of its own and
returns it; only names that the finished job returned count, so a repeated or
lost attempt leaves files that nothing reads.
"""

from __future__ import annotations

import uuid

from .common import by_value

by_value(__name__)


def file_system(uri: str):
    """(file system, path) for a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_new(folder: str, suffix: str, data: bytes) -> str:
    """Write ``data`` under a fresh name in ``folder`` and return its URI."""
    name = f"{folder}/{uuid.uuid4().hex}{suffix}"
    system, path = file_system(name)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)
    return name


def open_read(uri: str):
    """A seekable reader."""
    system, path = file_system(uri)
    return system.open_input_file(path)
