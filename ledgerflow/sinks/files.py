"""Files the driver itself handles: logs, manifests and folders of intermediate tables."""

from __future__ import annotations

import os

from pyarrow import fs

#: How stored and intermediate tables are compressed: the copies of payloads in a row are alike.
CODEC = "zstd"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or path, and the path there."""
    uri = uri.rstrip("/")
    return fs.FileSystem.from_uri(uri if ":/" in uri else os.path.abspath(uri))


def drop_folder(uri: str) -> None:
    """Remove a folder with all it holds, if it is there."""
    system, path = place(uri)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)
