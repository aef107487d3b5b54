"""Archive paths: normalising platform paths, escapes, and what may be extracted."""

from __future__ import annotations

import re
import unicodedata

from ..sources.errors import PathError
from .scalars import SEP

_ESCAPE = re.compile(r"\\x([0-9A-Fa-f]{2})")


def _component_fault(part: str) -> str | None:
    for c in part:
        if c in "/\\":
            return "slash in a component"
        kind = unicodedata.category(c)
        if kind == "Cc":
            return "control character"
        if kind.startswith("Z") and c != " ":
            return "separator other than a blank"
    return None


def _plain(part: str, escapes: bool, path: str) -> str:
    """The component without its escapes, which must be complete and stand for something permitted."""
    if not escapes:
        return part
    for m in _ESCAPE.finditer(part):
        c = chr(int(m[1], 16))
        if ord(c) >= 128 or c in "/" or unicodedata.category(c) == "Cc":
            raise PathError(f"escape {m[0]} isn't permitted", path=path)
    rest = _ESCAPE.sub("", part)
    if "\\" in rest:
        raise PathError("incomplete escape", path=path)
    return rest


def normalize(path: str, escapes: bool = False) -> str:
    """A platform path as an archive path: no root, ., or empty parts; .. drops the part before; trimmed and NFC."""
    parts: list[str] = []
    for raw in path.split("/"):
        if raw in ("", "."):
            continue
        if raw == "..":
            if parts:
                parts.pop()
            continue
        part = unicodedata.normalize("NFC", raw.strip())
        if not part:
            raise PathError("empty component", path=path)
        if (fault := _component_fault(_plain(part, escapes, path))) is not None:
            raise PathError(fault, path=path)
        parts.append(part)
    if not parts:
        raise PathError("no component is left", path=path)
    return SEP.join(parts)


def check_extractable(path: str, escapes: bool = False) -> None:
    """Refuses anything but a relative sequence of plain components; nothing is normalised."""
    parts = path.split(SEP)
    for part in parts:
        if part in ("", ".", ".."):
            raise PathError(f"component {part!r} isn't allowed", path=path)
        if re.match(r"^[A-Za-z]:", part) and len(parts) >= 1 and part is parts[0]:
            raise PathError("drive prefix", path=path)
        if (fault := _component_fault(_plain(part, escapes, path))) is not None:
            raise PathError(fault, path=path)
