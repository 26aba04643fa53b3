"""Self-describing JSON artifacts and their manifest. Results here are small: reports, trees, top lists."""

from __future__ import annotations

import json
import subprocess
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from provrank import schema


def plain(value: Any) -> Any:
    """JSON types: numpy scalars unwrapped, sets sorted, rows and mappings to dicts; TypeError for the rest."""
    if value is None or isinstance(value, str | bool | int | float):
        return value
    if hasattr(value, "asDict"):
        return plain(value.asDict(recursive=True))
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, set | frozenset):
        return sorted(plain(v) for v in value)
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if hasattr(value, "item") and getattr(value, "shape", ()) == ():
        return plain(value.item())
    raise TypeError(f"{type(value).__name__} has no JSON form here")


def provenance(config: dict | None = None, corpus_digest: str | None = None) -> dict:
    try:
        commit = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=5, cwd=Path(__file__).parent).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        commit = None
    return {"created": datetime.now(UTC).isoformat(timespec="seconds"), "commit": commit, "relations": list(schema.RELATIONS), "config": config or {}, "corpus_digest": corpus_digest}


def write(path: str | Path, payload: dict, **about) -> Path:
    """Write payload with its provenance, unless it brings one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    out = dict(payload)
    out.setdefault("provenance", provenance(**about))
    path.write_text(json.dumps(plain(out), indent=1, sort_keys=True, ensure_ascii=False))
    return path


def read(path: str | Path) -> dict:
    return json.loads(Path(path).read_text())


def manifest(folder: str | Path) -> dict:
    """index.json over the tree_ and ablate_ artifacts of a folder; unreadable ones are listed as skipped."""
    runs, skipped = [], []
    for p in sorted(Path(folder).glob("*.json")):
        if not p.name.startswith(("tree_", "ablate_")):
            continue
        try:
            runs.append({"file": p.name, "kind": p.name.split("_")[0], "seed": read(p).get("seed")})
        except (ValueError, OSError):
            skipped.append(p.name)
    found = {"runs": runs, "skipped": skipped}
    (Path(folder) / "index.json").write_text(json.dumps(found, indent=1))
    return found


def results_table(folder: str | Path) -> str:
    """Markdown tables of the evaluation artifacts of a folder, with the files that could not be read."""
    head = "| file | explainer | cells | testable | faithful | displacement | control |\n|-|-|-|-|-|-|-|\n"
    lines, bad = [], []
    for p in sorted(Path(folder).glob("*.json")):
        try:
            for r in read(p).get("report", []):
                lines.append(f"| {p.name} | {r['explainer']} | {r['n_candidates']} | {r['n_testable']} | {r['n_faithful']} | {r['displacement']:.2f} | {r['control_displacement']:.2f} |")
        except (ValueError, OSError, KeyError, TypeError, AttributeError):
            bad.append(p.name)
    return head + "\n".join(lines) + ("\n\nNot readable: " + ", ".join(bad) if bad else "") + "\n"
