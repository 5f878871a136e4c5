"""JSON by dot path, as markdown, and as flat metadata. Plain functions, for use in UDFs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any


def select(data: Any, path: str = ".") -> tuple[bool, Any]:
    """(found, value): keys of objects and whole numbers into lists; a JSON null is found."""
    for step in [s for s in path.strip().removeprefix(".").split(".") if s]:
        if isinstance(data, dict) and step in data:
            data = data[step]
        elif isinstance(data, list) and step.isdigit() and int(step) < len(data):
            data = data[int(step)]
        else:
            return False, None
    return True, data


def leaves(value: Any, path: str = "") -> Iterator[tuple[str, Any]]:
    """``a.b[0]`` and value of every leaf; an empty container is one."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    else:
        yield path, value


def scalar(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    return (json.dumps(v) if isinstance(v, (dict, list)) else str(v)).replace("\r", "\\r").replace("\n", "\\n")


def as_markdown(value: Any) -> str:
    """A heading for each element of a list (one for anything else), a bullet for each leaf."""
    items = value if isinstance(value, list) and value else [value]
    return "\n\n".join("\n".join([f"## Item {i}", *[f"- {p or 'value'}: {scalar(v)}" for p, v in leaves(x)]]) for i, x in enumerate(items, 1))


def flat_metadata(value: Any, most: int = 256, prefix: str = "json") -> dict[str, Any]:
    """``json__a__0__b`` -> leaf; long strings cut to ``most`` with ``...``; empty containers have none."""
    out: dict[str, Any] = {}

    def walk(v: Any, key: str) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{key}__{k}")
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{key}__{i}")
        else:
            out[key] = v[: most - 3] + "..." if isinstance(v, str) and len(v) > most else v

    walk(value, prefix)
    return out


def split(text: str, path: str = ".", ascii_only: bool = False, most: int = 256) -> list[tuple[str, dict[str, Any]]]:
    """(content, metadata) of each element of the list at ``path``, or of the one value;
    nothing for bad JSON or a path that isn't there."""
    try:
        found, value = select(json.loads(text), path)
    except ValueError:
        return []
    if not found:
        return []
    items = value if isinstance(value, list) else [value]
    return [(json.dumps(x, indent=2, ensure_ascii=ascii_only) if isinstance(x, (dict, list)) else str(x), {"json_index": i} | flat_metadata(x, most)) for i, x in enumerate(items)]
