"""Listing and reading files for the Python data source: mounted folders or object stores.

A path with a scheme (``s3://``, ``hdfs://``, ``gs://``, ``file://`` …) goes through ``pyarrow.fs``, any other through
the mounted file system.  Both give the same calls, so the source does not ask where files are.
"""

from __future__ import annotations

import fnmatch
import glob
import os
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote


@dataclass(frozen=True)
class Entry:
    name: str
    is_folder: bool
    #: A link to a folder is listed as one, and not entered.
    is_link: bool = False


class Mounted:
    """Files of a file system that driver and executors mount alike."""

    def list(self, path: str) -> list[Entry]:
        with os.scandir(path) as entries:
            return sorted((Entry(e.name, e.is_dir(), e.is_dir() and e.is_symlink()) for e in entries), key=lambda e: e.name)

    def is_folder(self, path: str) -> bool:
        return os.path.isdir(path)

    def size(self, path: str) -> int:
        return os.path.getsize(path)

    def open(self, path: str) -> BinaryIO:
        return open(path, "rb")

    def matching(self, pattern: str) -> list[str]:
        return sorted(glob.glob(pattern))


class Store:
    """Files of anything that ``pyarrow.fs`` reads, under URIs whose paths are plain text."""

    def _at(self, uri: str):
        from pyarrow import fs

        scheme, _, rest = uri.partition("://")
        host, slash, path = rest.partition("/")
        return fs.FileSystem.from_uri(f"{scheme}://{host}{slash}{quote(path)}")

    def list(self, path: str) -> list[Entry]:
        from pyarrow import fs

        system, inner = self._at(path)
        found = system.get_file_info(fs.FileSelector(inner, recursive=False))
        return sorted((Entry(x.base_name, x.type == fs.FileType.Directory) for x in found), key=lambda e: e.name)

    def _info(self, path: str):
        system, inner = self._at(path)
        return system.get_file_info(inner)

    def is_folder(self, path: str) -> bool:
        from pyarrow import fs

        return self._info(path).type == fs.FileType.Directory

    def size(self, path: str) -> int:
        info = self._info(path)
        if info.size is None:
            raise FileNotFoundError(path)
        return info.size

    def open(self, path: str) -> BinaryIO:
        system, inner = self._at(path)
        return system.open_input_file(inner)

    def matching(self, pattern: str) -> list[str]:
        folder, _, name = pattern.rpartition("/")
        return [f"{folder}/{e.name}" for e in self.list(folder) if not e.is_folder and fnmatch.fnmatchcase(e.name, name)]


def of(path: str) -> Mounted | Store:
    return Store() if "://" in path else Mounted()
