"""Flat files in a store that driver and executors share.

Paths are URIs (``file:``, ``hdfs:``, ``s3:``, ``gs:``; or plain local paths); pyarrow's file
systems open them.  A file is written under a name of its own attempt and then
renamed, so a task that is run again leaves one whole file.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri[len("file:") :].replace("///", "/", 1).replace("//", "/", 1)
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Appends to a file that gets its name when it is closed without an error."""

    def __init__(self, uri: str):
        self.store, self.path = open_store(uri)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.store.open_output_stream(self.draft)
        self.size = 0

    def append(self, data: bytes) -> int:
        """The offset at which the data stands."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, *_) -> None:
        self.out.close()
        if kind is None:
            self.store.move(self.draft, self.path)
        else:
            self.store.delete_file(self.draft)
