"""Settings from a YAML file, checked; and where a project keeps its pages, its code and its owners file."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from pathlib import Path

# Settings with their defaults, by section.
DEFAULTS: dict[str, dict] = {
    "links": {"timeout": 10, "concurrency": 20, "ignore_patterns": []},
    "cache": {"ttl_hours": 24, "max_size_mb": 100, "dir": None},
    "output": {"show_progress": True, "colors": "auto"},
}
# Where an owners file may be, and directories of pages and of code, in order.
OWNER_FILES = ("CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS")
DOC_DIRECTORIES = ("docs", "doc", "documentation")
CODE_DIRECTORIES = ("src", "lib", "app")
SNIPPET_SOURCE_DIRECTORIES = ("src", "lib", "app", "main", "source")


class InvalidSettings(ValueError):
    """A setting has a value that it can't have."""


def _positive(x) -> bool:
    return type(x) is int and x > 0


_RULES: dict[tuple[str, str], tuple[Callable, str]] = {
    ("links", "timeout"): (_positive, "a positive integer"),
    ("links", "concurrency"): (_positive, "a positive integer"),
    ("links", "ignore_patterns"): (lambda x: isinstance(x, list), "a list"),
    ("cache", "ttl_hours"): (_positive, "a positive integer"),
    ("cache", "max_size_mb"): (_positive, "a positive integer"),
    ("output", "colors"): (lambda x: x in ("auto", "always", "never"), "auto, always or never"),
}


def settings(given: dict | None = None) -> dict[str, dict]:
    """Defaults overlaid by what is given: unknown sections warn, unknown settings are ignored, wrong values raise."""
    given = given or {}
    if extra := set(given) - set(DEFAULTS):
        warnings.warn(f"unknown sections: {', '.join(sorted(map(str, extra)))}", stacklevel=2)
    out = {section: {k: (given.get(section) or {}).get(k, v) for k, v in values.items()} for section, values in DEFAULTS.items()}
    for (section, key), (fine, what) in _RULES.items():
        if not fine(out[section][key]):
            raise InvalidSettings(f"{section}.{key} must be {what}, not {out[section][key]!r}")
    return out


def load(path: str | Path | None = None, names: tuple[str, ...] = (".folioscope.yaml", ".folioscope.yml", "folioscope.yaml")) -> dict[str, dict]:
    """Settings of a file, which must exist if it is named; else of the first of ``names`` here; else the defaults."""
    import yaml

    if path is not None and not Path(path).exists():
        raise FileNotFoundError(path)
    found = Path(path) if path is not None else next((Path(n) for n in names if Path(n).exists()), None)
    if found is None:
        return settings()
    try:
        return settings(yaml.safe_load(found.read_text(encoding="utf-8")))
    except yaml.YAMLError as e:
        raise ValueError(f"{found} is no YAML: {e}") from e


def owners_file(root: str | Path) -> Path | None:
    """The first owners file of a project."""
    return next((Path(root) / n for n in OWNER_FILES if (Path(root) / n).exists()), None)


def directory(root: str | Path, names: tuple[str, ...], named_like_root: bool = False) -> Path:
    """The first of the directories that is there; with ``named_like_root`` also one of the root's name; else the root."""
    root = Path(root)
    all_ = [*names, root.resolve().name] if named_like_root else names
    return next((root / n for n in all_ if (root / n).is_dir()), root)
