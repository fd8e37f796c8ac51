"""Settings from a TOML file, overridden by arguments."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from pathlens.functions.exclude import DEFAULT_DIRS, clean_names


@dataclass(frozen=True)
class Config:
    roots: tuple[str, ...] = ()
    exclude_dirs: tuple[str, ...] = DEFAULT_DIRS
    hidden: bool = False
    follow_links: bool = False
    ignore: bool = True
    debounce_ms: int = 10
    snapshot_seconds: int = 300
    idle_seconds: int = 7_200
    watch_budget: int = 4_096
    scan_items_per_second: int = 5_000
    repair_mode: str = "dirty-only"
    repair_ratio: float = 0.3
    extra: dict = field(default_factory=dict, compare=False)


def load(path: str | None = None, **arguments) -> Config:
    """Defaults, then the file, then arguments that are not None. A list of excluded names adds the default ones."""
    raw = tomllib.loads(Path(path).read_text()) if path and Path(path).is_file() else {}
    names = {f.name for f in fields(Config)} - {"extra"}
    chosen = {k: v for k, v in raw.items() if k in names} | {k: v for k, v in arguments.items() if k in names and v is not None}
    for k in ("roots", "exclude_dirs"):
        if k in chosen:
            chosen[k] = tuple(chosen[k])
    if "exclude_dirs" in chosen:
        chosen["exclude_dirs"] = tuple(clean_names([*chosen["exclude_dirs"], *DEFAULT_DIRS]))
    return replace(Config(extra={k: v for k, v in raw.items() if k not in names}), **chosen)
