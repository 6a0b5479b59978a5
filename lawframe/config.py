"""Settings of the driver: a YAML file with ${NAME} taken from the environment."""

from __future__ import annotations

import os
import re
from pathlib import Path


def substituted(value, names: dict | None = None):
    """Every ${NAME} in the strings of a nested value replaced; names that are not set are empty."""
    names = os.environ if names is None else names
    if isinstance(value, dict):
        return {k: substituted(v, names) for k, v in value.items()}
    if isinstance(value, list):
        return [substituted(v, names) for v in value]
    return re.sub(r"\$\{([^}]+)\}", lambda m: names.get(m[1], ""), value) if isinstance(value, str) else value


def load_yaml(path: str, names: dict | None = None) -> dict:
    """The file's settings; none if there is no such file."""
    import yaml

    at = Path(path)
    return substituted(yaml.safe_load(at.read_text(encoding="utf-8")) or {}, names) if at.exists() else {}
