"""Configuration files and the paths that they name."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

ROOT_MARK = "pyproject.toml"


def load(path: str | Path) -> dict:
    """A YAML or JSON file of one mapping; an empty file is an empty mapping."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        content = json.loads(text or "{}")
    else:
        import yaml

        content = yaml.safe_load(text) or {}
    if not isinstance(content, dict):
        raise ValueError(f"{path} holds no mapping")
    return content


def root(start: str | Path) -> Path:
    """The nearest folder from ``start`` upwards that has a project file; ``start`` itself if none has."""
    first = Path(start).resolve()
    first = first if first.is_dir() else first.parent
    return next((p for p in (first, *first.parents) if (p / ROOT_MARK).exists()), first)


def path_of(catalogue: dict, name: str, base: str | Path) -> str:
    """The path that a catalogue gives for ``a.b.c``, below ``base`` unless it is absolute or an address."""
    at: object = catalogue
    for part in name.split("."):
        if not isinstance(at, dict) or part not in at:
            raise KeyError(f"the catalogue has no path {name}")
        at = at[part]
    return str(at) if "://" in str(at) or str(at).startswith("/") else f"{base}/{at}"


def arguments(config: dict, names: Sequence[str]) -> list[str]:
    """Command-line options for those names that a configuration gives; what is said on the command line later wins."""
    found = []
    for name in names:
        value = config.get(name, config.get(name.replace("-", "_")))
        if value is True:
            found.append(f"--{name}")
        elif value is not None and value is not False:
            found += [f"--{name}", *([str(v) for v in value] if isinstance(value, list) else [str(value)])]
    return found
