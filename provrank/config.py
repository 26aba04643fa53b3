"""Settings with dotted lookup and overrides from the environment."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, replace
from functools import cached_property
from pathlib import Path
from typing import Any

#: The defaults of the published settings.
DEFAULTS: dict[str, Any] = {
    "ppr": {"alpha": 0.15, "max_iter": 60, "tol": 1e-10},
    "retrieval": {"k1": 1.5, "b": 0.75, "rrf_k": 60, "w_rrf": 0.6, "w_ppr": 0.4, "top_k": 20, "pool_size": 200},
    "attribution": {"max_depth": 3, "min_share": 0.01, "max_edges": 40},
    "ablation": {"trials": 30, "alpha_level": 0.05, "rng_seed": 42},
    "tree": {"ratio": 3.0, "max_nodes": 15, "max_tiers": 6},
}


def _said(key: str) -> str | None:
    return os.environ.get("PROVRANK_" + key.upper().replace(".", "_"))


def _over(base: dict[str, Any], new: dict[str, Any]) -> dict[str, Any]:
    """base with the settings of new, section by section."""
    return base | {k: _over(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in new.items()}


@dataclass(frozen=True)
class Config:
    values: dict[str, Any] = field(default_factory=lambda: DEFAULTS)
    #: The folder that relative paths in the settings start from.
    folder: Path = field(default_factory=Path)

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """The defaults with the settings of a TOML file; FileNotFoundError without the file."""
        path = Path(path)
        return cls(_over(DEFAULTS, tomllib.loads(path.read_text())), path.parent)

    def with_value(self, key: str, value: Any) -> Config:
        for part in reversed(key.split(".")):
            value = {part: value}
        return replace(self, values=_over(self.values, value))

    def resolve(self, key: str) -> Path:
        """A setting that is a path, from the settings' folder unless it is absolute."""
        return self.folder / self.require(key)

    @cached_property
    def flat(self) -> dict[str, Any]:
        """Every setting by its dotted key, sections included; an environment variable PROVRANK_A_B overrides a.b in a.b's type."""
        known: dict[str, Any] = {}
        todo = list(self.values.items())
        while todo:
            key, value = todo.pop()
            known[key] = value
            if isinstance(value, dict):
                todo += [(f"{key}.{k}", v) for k, v in value.items()]
        return known | {k: type(v)(said) for k, v in known.items() if isinstance(v, int | float | str) and not isinstance(v, bool) and (said := _said(k)) is not None}

    def get(self, path: str, default: Any = None) -> Any:
        found = self.flat.get(path)
        return found if path in self.flat else default if (said := _said(path)) is None else said

    def require(self, path: str) -> Any:
        found = self.get(path)
        if found is None:
            raise KeyError(path)
        return found

    def section(self, name: str) -> dict[str, Any]:
        return {k: self.get(f"{name}.{k}") for k in self.values.get(name, {})}
