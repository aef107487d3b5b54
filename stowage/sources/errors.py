"""Errors of the archive format, with the path or offset they concern."""

from __future__ import annotations


class ArchiveError(Exception):
    """Anything wrong with an archive or a request on it."""

    def __init__(self, message: str, offset: int | None = None, path: str | None = None):
        self.message, self.offset, self.path = message, offset, path
        where = "" if offset is None else f" at byte {offset}"
        super().__init__(f"{message}{where}" + (f": {path}" if path else ""))

    def __reduce__(self):  # travels from workers to the driver
        return type(self), (self.message, self.offset, self.path)


class ParseError(ArchiveError):
    """Bytes that are no valid archive."""


class OpenError(ArchiveError):
    """An archive that can't be opened."""


class PathError(ArchiveError):
    """A path that can't be stored or extracted."""


class CodecError(ArchiveError):
    """An unknown codec that is needed, or a payload that doesn't decode."""


class WriteError(ArchiveError):
    """A write that would break the archive's rules."""


class ExtractError(ArchiveError):
    """An extraction that isn't allowed or fails."""
