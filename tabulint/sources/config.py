"""Settings of an analysis from a JSON file, and a first file to start from."""

from __future__ import annotations

import copy
import json
import subprocess
from typing import Any

DEFAULTS: dict[str, Any] = {
    "code": {"max_function_lines": 50, "max_params": 5, "max_methods": 20, "exclude": [], "naming": {"function": "snake", "class": "pascal", "constant": "screaming"}},
    "security": {"forbid_weak_crypto": ["md5", "sha1"], "weak_crypto_allowlist": {}},
    "confidence_thresholds": {"auto_fix": 0.85, "review": 0.5},
    "deploy_gate": {"min_overall": 85, "min_security": 90, "max_critical": 0},
}


def merged(base: dict, own: dict) -> dict:
    """base with the values of own put over it, level by level."""
    out = copy.deepcopy(base)
    for k, v in own.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(text: str | None) -> dict:
    """The settings of a file's text over the defaults; a text that is no JSON
    object is an error."""
    if text is None:
        return copy.deepcopy(DEFAULTS)
    own = json.loads(text)
    if not isinstance(own, dict):
        raise ValueError("settings are a JSON object")
    return merged(DEFAULTS, own)


def at(settings: dict, pointer: str, default: Any = None) -> Any:
    """The value that a JSON pointer names."""
    value: Any = settings
    for part in pointer.strip("/").split("/"):
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(value, list) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        elif isinstance(value, dict) and part in value:
            value = value[part]
        else:
            return default
    return value


def scaffold() -> str:
    return json.dumps(DEFAULTS, indent=2) + "\n"


def changed_files(root: str, ref: str = "HEAD") -> list[str]:
    """Paths that differ from a git revision, untracked ones included, sorted."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], check=True, capture_output=True, text=True).stdout.splitlines()
    return sorted({p for p in run("diff", "--name-only", ref) + run("ls-files", "--others", "--exclude-standard") if p})
