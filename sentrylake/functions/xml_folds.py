"""Pairs of an XML document by a pull scanner: one pass over its events with a stack of open elements, as an Arrow function.

Keys are the dotted path of local names below the root; an element with text and a ``Name`` goes by that name. Text is what stands before the first
child, with CDATA and entities read; attributes come before it. A document that declares a DOCTYPE (and so any entity) is refused, as is one that is not
well-formed or longer than ``bytes_``; after ``most`` pairs no further element is opened.
"""

from __future__ import annotations

from functools import lru_cache
from xml.parsers import expat

BYTES, PAIRS = 65_536, 400


class _Open:
    """An element whose first child has not begun."""

    __slots__ = ("attributes", "closed", "name", "parent", "path", "text")

    def __init__(self, name: str, attributes: list[str], parent: str | None):
        self.name, self.attributes, self.parent, self.text, self.path, self.closed = name, attributes, parent, "", "", False


@lru_cache(4096)
def _local(name: str) -> str:
    return name.rpartition(" ")[2].rpartition(":")[2]


def scan(text: str | None, keys: list[str], values: list[str], most: int = PAIRS, bytes_: int = BYTES) -> bool:
    """Whether a document is one that is read and has pairs; these are added to ``keys`` and ``values``, in its order."""
    body = (text or "").strip()
    if not body.startswith("<") or len(body) > bytes_ or (len(body) * 4 > bytes_ and len(body.encode()) > bytes_):
        return False
    begin = len(keys)
    full = begin + most
    stack: list[_Open] = []
    skipped = 0  # depth within an element that is not opened any more

    def settle(e: _Open, has_children: bool) -> None:
        """What an element says itself, when its first child begins or it ends."""
        e.closed, value, parent, attributes = True, e.text.strip(), e.parent, e.attributes
        own, by_name = e.name, False
        if attributes and value:
            names = attributes[::2]
            named = next((attributes[2 * names.index(k) + 1] for k in ("Name", "name") if k in names), None)
            by_name = named is not None
            own = named if by_name else own
        e.path = path = "" if parent is None else f"{parent}.{own}" if parent else own
        for i in range(0, len(attributes), 2):
            key = _local(attributes[i])
            if not (by_name and key.lower() == "name"):
                keys.append(f"{path}.{key}" if path else key)
                values.append(attributes[i + 1].strip())
        if value and not (parent is None and has_children):
            keys.append(path or e.name)
            values.append(value)

    def start(name: str, attributes: list[str]) -> None:
        nonlocal skipped
        if not skipped and stack and not stack[-1].closed:
            settle(stack[-1], True)
        if skipped or len(keys) >= full:
            skipped += 1
            return
        stack.append(_Open(_local(name), attributes, stack[-1].path if stack else None))

    def end(_name: str) -> None:
        nonlocal skipped
        if skipped:
            skipped -= 1
            return
        e = stack.pop()
        if not e.closed:
            settle(e, False)

    def data(more: str) -> None:
        if stack and not skipped and not stack[-1].closed:
            stack[-1].text += more

    def refuse(*_: object) -> None:
        raise ValueError

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.ordered_attributes = parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, data, refuse
    try:
        parser.Parse(body, True)
    except (ValueError, expat.ExpatError):
        del keys[begin:], values[begin:]
        return False
    return len(keys) > begin


def pairs(text: str | None, most: int = PAIRS, bytes_: int = BYTES) -> list[dict[str, str]] | None:
    """(key, value) of a document in its order; null where it is none that is read, or has none."""
    keys: list[str] = []
    values: list[str] = []
    return [{"key": k, "value": v} for k, v in zip(keys, values, strict=True)] if scan(text, keys, values, most, bytes_) else None
