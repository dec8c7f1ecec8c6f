"""Run manifests: JSON documents whose unknown keys survive, with paths relative to themselves."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import Any

VERSION = 2
#: Cell space and expression model of every kind of run (fixed values of the format).
KINDS = {
    "topic": ("log_simplex", "topic"),
    "itopic": ("log_simplex", "topic"),
    "joint-topic": ("log_simplex", "topic"),
    "masked-vae": ("signed", "topic_logits"),
    "vae": ("signed", "latent_loadings"),
    "rbm": ("signed", "latent_loadings"),
    "svd": ("signed", "unmodelled"),
    "joint-svd": ("signed", "unmodelled"),
    "ode": ("signed", "unmodelled"),
    "bge": ("embedding", "embedding"),
    "simba": ("embedding", "embedding"),
    "resolve-embedding-space": ("embedding", "embedding"),
    "fne": ("embedding", "unmodelled"),
}
#: Old top-level keys and the slot that holds them since version 2.
LIFTED = {"cell_to_pb": "outputs", "latent": "outputs", "dictionary": "outputs", "clusters": "cluster", "coordinates": "layout"}


def load(path: str | os.PathLike) -> dict[str, Any]:
    """The document, old keys lifted into their slots; a newer version is kept and told by ``newer``."""
    doc = json.loads(Path(path).read_text())
    if doc.get("version", 1) < VERSION:
        for key, slot in LIFTED.items():
            if key in doc:
                doc.setdefault(slot, {}).setdefault(key, doc.pop(key))
        doc["version"] = VERSION
    return doc


def newer(doc: dict[str, Any]) -> bool:
    return doc.get("version", 1) > VERSION


def save(path: str | os.PathLike, changes: dict[str, Any]) -> dict[str, Any]:
    """Merges changes into the document on disk, key by key within slots, and puts it in place at once."""
    p = Path(path)
    doc = load(p) if p.exists() else {"version": VERSION}

    def merge(into: dict, what: dict) -> None:
        for k, v in what.items():
            if isinstance(v, dict) and isinstance(into.get(k), dict):
                merge(into[k], v)
            else:
                into[k] = v

    merge(doc, changes)
    stage = p.with_suffix(p.suffix + ".new")
    stage.write_text(json.dumps(doc, indent=1, sort_keys=True))
    os.replace(stage, p)
    return doc


def resolve(path: str, manifest: str | os.PathLike, search: tuple[str, ...] = ()) -> str:
    """A recorded path as it is now: absolute, beside the manifest, or by its name in a folder searched."""
    base = Path(manifest).resolve().parent
    for p in (Path(path), base / path, *(Path(s) / Path(path).name for s in (str(base), *search))):
        if p.exists():
            return str(p)
    raise FileNotFoundError(f"{path}, recorded in {manifest}")


def relative(path: str, manifest: str | os.PathLike) -> str:
    base = Path(manifest).resolve().parent
    p = Path(path).resolve()
    return str(p.relative_to(base)) if p.is_relative_to(base) else str(p)


def differences(a: Any, b: Any, at: str = "") -> list[tuple[str, Any, Any]]:
    """(key, old, new) of settings that differ between two runs."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [x for k in sorted({*a, *b}) for x in differences(a.get(k), b.get(k), f"{at}.{k}" if at else k)]
    return [] if a == b else [(at, a, b)]


def add_round(doc: dict[str, Any], parent: str, labels: dict[str, Any]) -> dict[str, Any]:
    """The document with one more round of history; its recorded inputs can't repeat."""
    history = list(doc.get("history", []))
    known = {os.path.normpath(p) for r in history for p in r.get("data", [])}
    repeated = [p for p in labels.get("data", []) if os.path.normpath(p) in known]
    if repeated:
        raise ValueError(f"already recorded: {', '.join(repeated)}")
    return doc | {"history": [*history, {"parent": parent} | labels]}


def scale(columns_sum: list[float], exp_sum: list[float], least: float) -> str:
    """``log_simplex``, ``simplex`` or ``signed`` of a matrix by its columns' sums, sums of exp, and least entry; no column: signed."""
    if columns_sum and all(abs(s - 1) < 1e-2 for s in exp_sum):
        return "log_simplex"
    if columns_sum and least >= 0 and all(abs(s - 1) < 1e-2 for s in columns_sum):
        return "simplex"
    return "signed"
