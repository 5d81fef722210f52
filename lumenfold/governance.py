"""Provenance on the driver: identities, checksums, sealed layers, one-shot access, manifests."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from pathlib import Path

from .specs import ContractError

IDENTITY = ("experiment_id", "code_version", "config_sha256", "data_sha256", "schema_version", "seed", "created_at")


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def sha256(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def file_sha256(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def atomic_write(path: str | Path, data: bytes | str) -> None:
    """All or nothing: a temporary file beside the target is flushed to disk, then renamed."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data.encode() if isinstance(data, str) else data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    finally:
        Path(name).unlink(missing_ok=True)


def atomic_json(path: str | Path, value: object) -> None:
    atomic_write(path, json.dumps(value, sort_keys=True, indent=1, allow_nan=False) + "\n")


@dataclass(frozen=True)
class Config:
    seed: int
    validation_fraction: float = 0.1
    test_fraction: float = 0.1
    least_rows: Mapping[str, int] | None = None
    benign_share: float = 0.995
    maximum_fpr: float = 0.001
    replicates: int = 1000

    def __post_init__(self):
        wrong = []
        if not 0 < self.validation_fraction < 1 or not 0 < self.test_fraction < 1 or self.validation_fraction + self.test_fraction >= 1:
            wrong.append("fractions")
        if not 0 < self.benign_share <= 1 or not 0 < self.maximum_fpr < 1:
            wrong.append("rates")
        if self.replicates < 100:
            wrong.append("replicates")
        if wrong:
            raise ContractError(f"configuration: {', '.join(wrong)}")


def experiment_id(config: Mapping, data_sha256: str, code_version: str) -> str:
    """Twenty hex digits of what an experiment is made of; when it was made isn't part of it."""
    return sha256(canonical({"config": {k: v for k, v in config.items() if k != "created_at"}, "data": data_sha256, "code": code_version}))[:20]


def write_sidecar(path: str | Path, identity: Mapping[str, object]) -> Path:
    if missing := [k for k in IDENTITY if k not in identity]:
        raise ContractError(f"identity lacks {missing}")
    out = Path(f"{path}.meta.json")
    atomic_json(out, {**{k: identity[k] for k in IDENTITY}, "file": Path(path).name, "sha256": file_sha256(path), "bytes": Path(path).stat().st_size})
    return out


def verify_sidecar(path: str | Path, identity: Mapping[str, object] | None = None) -> dict:
    side = json.loads(Path(f"{path}.meta.json").read_text())
    if side["sha256"] != file_sha256(path) or side["bytes"] != Path(path).stat().st_size:
        raise ContractError(f"{path} is not what its sidecar says")
    if identity and any(side[k] != v for k, v in identity.items() if k in IDENTITY):
        raise ContractError(f"{path} belongs to another experiment")
    return side


def listing(folder: str | Path) -> dict[str, str]:
    root = Path(folder)
    return {str(p.relative_to(root)): file_sha256(p) for p in sorted(root.rglob("*")) if p.is_file() and p.name not in ("SEALED", "manifest.json") and not p.name.startswith(("_", "."))}


def seal(folder: str | Path, manifest: Mapping) -> str:
    """Writes the manifest with all files' digests, then the seal, its digest; a sealed folder is refused."""
    root = Path(folder)
    if (root / "SEALED").exists():
        raise ContractError(f"{root} is sealed")
    text = json.dumps({**manifest, "files": listing(root)}, sort_keys=True, indent=1)
    atomic_write(root / "manifest.json", text)
    atomic_write(root / "SEALED", sha256(text))
    return sha256(text)


def verify_seal(folder: str | Path) -> dict:
    root = Path(folder)
    text = (root / "manifest.json").read_text()
    if (root / "SEALED").read_text() != sha256(text):
        raise ContractError("the manifest is not the one that was sealed")
    manifest = json.loads(text)
    now = listing(root)
    if changed := sorted(set(now.items()) ^ set(manifest["files"].items())):
        raise ContractError(f"files differ: {sorted({k for k, _ in changed})}")
    return manifest


def open_partition(folder: str | Path, partition: str) -> str:
    """The path of train or validation of a sealed split; test is opened through a ledger only."""
    if partition not in ("train", "validation"):
        raise ContractError(f"{partition} can't be opened for training")
    verify_seal(folder)
    return str(Path(folder) / partition)


class Ledger:
    """One access to the test partition: the claim is a file that is made exclusively."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def claim(self, token: str, purpose: str) -> None:
        try:
            fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600)
        except FileExistsError as e:
            raise ContractError("the test partition was opened before") from e
        with os.fdopen(fd, "w") as f:
            f.write(canonical({"token_sha256": sha256(token), "purpose": purpose, "state": "claimed"}))

    def finish(self, token: str, result_sha256: str) -> None:
        entry = json.loads(self.path.read_text())
        if entry["token_sha256"] != sha256(token) or entry["state"] != "claimed":
            raise ContractError("not the claim that is open")
        atomic_write(self.path, canonical({**entry, "state": "finished", "result_sha256": result_sha256}))


def verify_chain(manifests: list[Mapping]) -> None:
    """Each manifest names the digest of the one before."""
    for before, after in zip(manifests[:-1], manifests[1:], strict=True):
        if after.get("previous_sha256") != sha256(canonical(before)):
            raise ContractError("the chain of manifests is broken")


def archive(path: str | Path, folder: str | Path) -> Path:
    """Moves a result to a folder, under its digest."""
    p = Path(path)
    target = Path(folder) / f"{file_sha256(p)[:16]}-{p.name}"
    target.parent.mkdir(parents=True, exist_ok=True)
    os.replace(p, target)
    return target


@dataclass(frozen=True)
class Bundle:
    """What a deployment needs; saved as JSON with its digest."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    threshold: float
    median: tuple[float, ...]
    mad: tuple[float, ...]
    identity: Mapping[str, object]

    def validate(self) -> None:
        n = len(self.features)
        if not n or any(len(x) != n for x in (self.weights, self.median, self.mad)) or not 0 <= self.threshold <= 1 or min(self.mad) < 0:
            raise ContractError("the bundle doesn't fit together")

    def save(self, path: str | Path) -> None:
        self.validate()
        body = asdict(self)
        atomic_json(path, {"bundle": body, "sha256": sha256(canonical(body))})

    @classmethod
    def load(cls, path: str | Path) -> Bundle:
        found = json.loads(Path(path).read_text())
        if sha256(canonical(found["bundle"])) != found["sha256"]:
            raise ContractError("the bundle was changed")
        b = {k: tuple(v) if isinstance(v, list) else v for k, v in found["bundle"].items()}
        out = cls(**b)
        out.validate()
        return out


def markdown(rows: list[Mapping], columns: tuple[str, ...]) -> str:
    """A table for reports; floats with four digits, nothing for null."""
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows)]) + "\n"
