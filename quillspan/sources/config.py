"""Configuration files and checkpoints: small driver-side helpers, no Spark."""

from __future__ import annotations

from pathlib import Path
from typing import Any


def load(path: str) -> dict[str, Any]:
    """A YAML file as a dict (PyYAML, if it is installed) or a JSON file."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        import json

        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML; JSON works without") from e
    return yaml.safe_load(text) or {}


def merge(base: dict, other: dict) -> dict:
    """``other`` over ``base``, dicts merged recursively; neither is changed."""
    out = dict(base)
    for k, v in other.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def get(config: dict, path: str, default: Any = None) -> Any:
    """The value at a dotted path."""
    at: Any = config
    for part in path.split("."):
        if not isinstance(at, dict) or part not in at:
            return default
        at = at[part]
    return at


def checkpoints(folder: str) -> list[str]:
    """Model folders below ``folder`` that hold best/config.json, sorted."""
    return sorted(str(p.parent.parent) for p in Path(folder).glob("*/best/config.json"))
