"""Where data come from: registered sources, approval, verified files, capped downloads, pinned archives (driver only)."""

from __future__ import annotations

import hashlib
import os
import tempfile
import urllib.request
import zipfile
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from ..governance import atomic_write
from ..specs import ContractError

CHUNK = 1 << 20


@dataclass(frozen=True)
class Source:
    name: str
    url: str = ""
    path: str = ""
    sha256: str = ""
    licence: str = ""
    enabled: bool = False
    approved: bool = False
    max_bytes: int = 0
    columns: Mapping[str, str] = field(default_factory=dict)


def registry(document: Mapping[str, Mapping]) -> dict[str, Source]:
    """Typed sources of a parsed registry file; unknown keys are an error."""
    known = set(Source.__dataclass_fields__) - {"name"}
    out = {}
    for name, entry in document.items():
        if extra := sorted(set(entry) - known):
            raise ContractError(f"source {name}: unknown keys {extra}")
        out[name] = Source(name, **entry)
    return out


def approval_problems(s: Source) -> list[str]:
    """All reasons why a source may not be used."""
    found = {
        "not enabled": not s.enabled,
        "not approved": not s.approved,
        "no licence": not s.licence,
        "no checksum": len(s.sha256) != 64,
        "no size limit": s.max_bytes <= 0,
        "neither url nor path": not (s.url or s.path),
        "not https": bool(s.url) and not s.url.startswith("https://"),
    }
    return [k for k, v in found.items() if v]


def digest(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(CHUNK):
            h.update(block)
    return h.hexdigest()


def verify(path: str | Path, s: Source, endings: tuple[str, ...] = (".parquet", ".csv", ".jsonl")) -> None:
    """Ending, size, no archive in disguise, checksum."""
    p = Path(path)
    if p.suffix.lower() not in endings:
        raise ContractError(f"{p.name}: ending")
    if not 0 < p.stat().st_size <= s.max_bytes:
        raise ContractError(f"{p.name}: size")
    if zipfile.is_zipfile(p):
        raise ContractError(f"{p.name}: an archive")
    if digest(p) != s.sha256:
        raise ContractError(f"{p.name}: checksum")


def members(path: str | Path, endings: tuple[str, ...]) -> list[str]:
    """Names in an archive, none of which leaves its folder or has another ending."""
    with zipfile.ZipFile(path) as z:
        names = [i.filename for i in z.infolist() if not i.is_dir()]
    for n in names:
        if n.startswith("/") or ".." in Path(n).parts or "\\" in n or Path(n).suffix.lower() not in endings:
            raise ContractError(f"member {n}")
    return names


def acquire(s: Source, folder: str | Path, opener=urllib.request.urlopen) -> Path:
    """Downloads an approved source, at most max_bytes, and publishes it once its checksum is right."""
    if problems := approval_problems(s):
        raise ContractError(f"source {s.name}: {', '.join(problems)}")
    target = Path(folder) / os.path.basename(s.url)
    fd, name = tempfile.mkstemp(dir=folder, suffix=Path(s.url).suffix)
    try:
        with os.fdopen(fd, "wb") as out, opener(s.url) as response:
            size = 0
            while block := response.read(CHUNK):
                size += len(block)
                if size > s.max_bytes:
                    raise ContractError(f"source {s.name}: more than {s.max_bytes} bytes")
                out.write(block)
        verify(name, s)
        os.replace(name, target)
    finally:
        Path(name).unlink(missing_ok=True)
    return target


def single_member(path: str | Path, sha256: str, out: str | Path, endings: tuple[str, ...] = (".csv",), most: int = 1 << 30) -> Path:
    """The one table of a pinned archive, written beside it."""
    if digest(path) != sha256:
        raise ContractError("checksum of the archive")
    names = members(path, endings)
    if len(names) != 1:
        raise ContractError(f"one member is expected, not {len(names)}")
    with zipfile.ZipFile(path) as z, z.open(names[0]) as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ContractError("the member is too large")
    atomic_write(out, data)
    return Path(out)


def require(names: Iterable[str], present: Iterable[str]) -> None:
    if missing := sorted(set(names) - set(present)):
        raise ContractError(f"missing: {missing}")
