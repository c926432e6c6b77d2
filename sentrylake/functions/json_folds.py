"""Folds over a JSON text from its innermost values outwards, as Arrow functions.

The parser hands over every object when it ends, so nothing here recurses and no depth is cut off; a text that is nested deeper than the parser
itself goes is no JSON here. Numbers keep their spelling and members their order; of members with one name the last counts, at the place of the first.
"""

from __future__ import annotations

import json
from typing import Any


class Number(str):
    """A number as it is spelled."""


class Flat(list):
    """The values of an object by their paths: ((key, ...), value)."""


class Pruned(str):
    """An object's JSON without empty members; ``was_empty`` if it had none to begin with."""

    was_empty = False


def _load(text: str | None, members) -> Any:
    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        return json.loads(text, object_pairs_hook=members, parse_int=Number, parse_float=Number, parse_constant=refuse)
    except (TypeError, ValueError, RecursionError):
        return None


def _shown(value: Any) -> str | None:
    """A plain value as text; null stays null."""
    return {True: "true", False: "false"}[value] if isinstance(value, bool) else None if value is None else str(value)


def _members(pairs: list[tuple[str, Any]]) -> Flat:
    out = Flat()
    for key, value in dict(pairs).items():
        if isinstance(value, Flat):
            out += [((key, *path), v) for path, v in value]
        elif isinstance(value, list):
            if value and not any(isinstance(x, list) for x in value):
                out.append(((key,), ", ".join("null" if x is None else _shown(x) for x in value)))
        else:
            out.append(((key,), _shown(value)))
    return out


def flatten(text: str | None) -> list[dict[str, str | None]] | None:
    """Dotted keys and values of a JSON object, null where the text is none."""
    found = _load(text, _members)
    if not isinstance(found, Flat):
        return None
    pairs = []
    for path, value in found:
        name = ""
        for key in path:
            name = f"{name}.{key}" if name else key
        pairs.append({"key": name, "value": value})
    return pairs


def _empty(value: Any) -> bool:
    return value is None or value == "" or (isinstance(value, Pruned) and value == "{}") or value == []


def _written(value: Any) -> str:
    if isinstance(value, Number | Pruned):
        return str.__str__(value)
    return f"[{','.join(map(_written, value))}]" if isinstance(value, list) else json.dumps(value, ensure_ascii=False)


def _listed(values: list) -> list:
    """A list without elements that are empty as they stand; what becomes empty by pruning stays."""
    kept = [v for v in values if not (v is None or v == [] or (isinstance(v, Pruned) and v.was_empty) or (v == "" and not isinstance(v, Pruned)))]
    return [_listed(v) if isinstance(v, list) else v for v in kept]


def _without_empty(pairs: list[tuple[str, Any]]) -> Pruned:
    kept = {k: _listed(v) if isinstance(v, list) else v for k, v in dict(pairs).items()}
    out = Pruned("{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_written(v)}" for k, v in kept.items() if not _empty(v)) + "}")
    out.was_empty = not pairs
    return out


def prune(text: str | None) -> str | None:
    """The JSON without empty members, null where the text is no JSON."""
    found = _load(text, _without_empty)
    if found is None and (text or "").strip() != "null":
        return None
    return _written(_listed(found) if isinstance(found, list) else found)
