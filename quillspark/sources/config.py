"""Settings, and which readers can run."""

from __future__ import annotations

import importlib.util
import json
import os
from typing import Any

from .elements import EXTERNAL

#: The library that an external reader needs.
LIBRARIES = {name: name for name in EXTERNAL} | {"hybrid_table": "pdfplumber", "pymupdf": "fitz"}
STRATEGIES = (*EXTERNAL, "auto")


def load(source: str | dict | None) -> dict[str, Any]:
    """Settings from a dict, a JSON file, or a YAML file where a YAML library is installed; nothing or a missing file gives none."""
    if isinstance(source, dict):
        return source
    if not source or not os.path.exists(source):
        return {}
    with open(source, encoding="utf-8") as f:
        if source.endswith(".json"):
            return json.load(f) or {}
        if not importlib.util.find_spec("yaml"):
            raise ValueError(f"{source}: no YAML library is installed; give JSON or a dict")
        import yaml

        return yaml.safe_load(f) or {}


def section(settings: dict[str, Any], name: str) -> dict[str, Any]:
    """The section's values over those of the top level."""
    own = settings.get(name)
    return {**settings, **own} if isinstance(own, dict) else dict(settings)


def first_of(settings: dict[str, Any], paths: list[str], default: Any, kind: type = float) -> Any:
    """The first dotted path that holds a value of the kind, else the default."""
    for path in paths:
        at: Any = settings
        for key in path.split("."):
            at = at.get(key) if isinstance(at, dict) else None
        try:
            if at is not None:
                return kind(at)
        except (TypeError, ValueError):
            continue
    return default


def available(names: tuple[str, ...] = EXTERNAL) -> dict[str, bool]:
    """Whether the library of each external reader is installed."""
    return {n: importlib.util.find_spec(LIBRARIES[n]) is not None for n in names}


def strategies(wanted: list[str], registered: list[str]) -> list[str]:
    """The strategies that can run, in the order wanted; unknown names are errors, and so is a list of which none can run."""
    unknown = [n for n in wanted if n not in STRATEGIES and n not in registered]
    if unknown:
        raise ValueError(f"unknown strategies {unknown}; there are {sorted({*STRATEGIES, *registered})}")
    have = [n for n in wanted if n == "auto" or n in registered]
    if not have:
        raise ValueError(f"none of {wanted} has a reader here")
    return have
