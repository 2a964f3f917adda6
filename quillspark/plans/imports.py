"""Files that schemas and transforms import, read on the driver from below one folder."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path


class ImportProblem(ValueError):
    """An import that can't be followed; the message begins with a code."""


def files_below(root: str, suffixes: tuple[str, ...] = (), most_bytes: int = 10 << 20) -> Callable[[str], str]:
    """A reader of files by path, relative to ``root`` and never outside of it; ``suffixes`` (if any) are those allowed."""
    base = Path(root).resolve()

    def read(path: str) -> str:
        if not path.strip():
            raise ImportProblem("I001: the path is empty")
        if "\0" in path:
            raise ImportProblem("I001: the path holds a null character")
        if "://" in path:
            raise ImportProblem(f"I001: no remote files: {path}")
        if suffixes and not path.endswith(suffixes):
            raise ImportProblem(f"I003: the file's kind is not allowed: {path}")
        found = (base / path).resolve()
        if not found.is_relative_to(base):
            raise ImportProblem(f"I004: the path leaves the folder: {path}")
        if not found.is_file():
            raise ImportProblem(f"I006: there is no file {path}")
        if found.stat().st_size > most_bytes:
            raise ImportProblem(f"I005: the file is too large: {path}")
        try:
            return found.read_text(encoding="utf-8")
        except (OSError, UnicodeDecodeError) as e:
            raise ImportProblem(f"I008: the file can't be read: {path}") from e

    return read
