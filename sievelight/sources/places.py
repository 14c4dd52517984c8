"""File handles for a path in any file system that an executor can reach."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from dataclasses import dataclass
from functools import lru_cache
from typing import IO

from pyarrow import fs

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]+)://([^/]*)")
_PART = re.compile(r"\.part-[0-9a-f]{32}\Z")
_LOCAL = fs.LocalFileSystem()
GROUP_FILES = 256
GROUP_BYTES = 64 << 20


@lru_cache(maxsize=16)
def _store(scheme: str, authority: str) -> fs.FileSystem:
    """One client per store and worker process."""
    return fs.FileSystem.from_uri(f"{scheme}://{authority}/")[0]


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path and the path inside it; an unknown scheme raises."""
    found = _SCHEME.match(path)
    if found and found[1].lower() != "file":
        return _store(found[1], found[2]), fs.FileSystem.from_uri(path)[1]
    return _LOCAL, path.removeprefix("file://").removeprefix("file:")


def open_read(path: str):
    store, inner = place_of(path)
    return store.open_input_file(inner)


def size_of(path: str) -> int:
    store, inner = place_of(path)
    info = store.get_file_info(inner)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(f"no file at {path}")
    return info.size


def is_part(name: str) -> bool:
    """Whether a name is a temporary one of ``write_each``."""
    return _PART.search(name) is not None


@dataclass
class _Part:
    """A file under its temporary name, or why there is none. A local one stays open until it is flushed, which spares opening it again."""

    path: str
    check: Callable[[str], None] | None
    name: str | None = None
    error: Exception | None = None
    handle: IO | None = None

    def begin(self, write: Callable) -> int:
        """Bytes written."""
        store, inner = place_of(self.path)
        self.name = f".part-{uuid.uuid4().hex}"
        try:
            self.handle = _new(store, inner + self.name)
            write(self.handle)
            size = self.handle.tell()
            if store is not _LOCAL:
                self.close()
            return size
        except BaseException as e:
            self.drop()
            if not isinstance(e, Exception):
                raise
            self.error = e
            return 0

    def flush(self) -> None:
        if self.error is None and self.handle:
            try:
                self.handle.flush()
                os.fsync(self.handle.fileno())
                self.close()
            except Exception as e:
                self.fail(e)

    def close(self) -> None:
        handle, self.handle = self.handle, None
        if handle:
            handle.close()

    def move(self) -> None:
        if self.error is None:
            store, inner = place_of(self.path)
            try:
                if self.check:
                    self.check(self.path + self.name)
                store.move(inner + self.name, inner)
                self.name = None
            except Exception as e:
                self.fail(e)

    def fail(self, error: Exception) -> None:
        self.error = error
        self.drop()

    def drop(self) -> None:
        with suppress(Exception):  # what it holds is not wanted
            self.close()
        if self.name:
            store, inner = place_of(self.path)
            if store.get_file_info(inner + self.name).type == fs.FileType.File:
                store.delete_file(inner + self.name)
            self.name = None


def _new(store: fs.FileSystem, path: str):
    """A handle on a new file; its folder is made only when it is not there, which most files find."""
    if store is not _LOCAL:
        if home := os.path.dirname(path):
            store.create_dir(home, recursive=True)
        return store.open_output_stream(path)
    try:
        return open(path, "wb")
    except FileNotFoundError:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")


def write_each(files: Iterable[tuple[str, Callable, Callable[[str], None] | None]]) -> Iterator[Exception | None]:
    """For each ``(path, write, check)`` run ``write(handle)`` on a new file beside ``path`` and move it there once it is on disk: what failed, or None.

    Files are flushed together, ``GROUP_FILES`` or ``GROUP_BYTES`` at a time, since one flush of the file system's journal serves them
    all; none is moved before it is flushed. ``check`` gets the path of the new file before the move and may raise; no part of a failed file stays.
    """
    held: list[_Part] = []
    size = 0

    def settle() -> list[Exception | None]:
        for part in held:
            part.flush()
        for part in held:
            part.move()
        done = [part.error for part in held]
        held.clear()
        return done

    try:
        for path, write, check in files:
            held.append(_Part(path, check))
            try:
                size += held[-1].begin(write)
            except Exception as e:  # the place is unknown
                held[-1].error = e
            if len(held) >= GROUP_FILES or size >= GROUP_BYTES:
                size = 0
                yield from settle()
        yield from settle()
    finally:
        for part in held:
            part.drop()


def write_whole(path: str, write: Callable, check: Callable[[str], None] | None = None) -> None:
    """``write_each`` for one file; what fails is raised."""
    for error in write_each([(path, write, check)]):
        if error:
            raise error


def reason_of(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"
