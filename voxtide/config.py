"""Run settings and the two text formats they are kept in."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields


@dataclass(frozen=True)
class Optics:
    """Reconstruction geometry; lengths in micrometres."""

    z0: float = 0.0
    dz: float = 100.0
    planes: int = 256
    wavelength: float = 0.632
    resolution: float = 1.0
    zero_pad: int = 256

    def depths(self) -> list[float]:
        return [self.z0 + i * self.dz for i in range(self.planes)]


@dataclass(frozen=True)
class Solver:
    l1: float = 0.01
    tv: float = 0.0
    outer: int = 500
    inner: int = 5
    backtracks: int = 2
    shrink: float = 0.5


@dataclass(frozen=True)
class Segmentation:
    min_intensity: float = 0.0
    close_size: float = 0.0
    min_voxels: int = 1
    min_depth: int = 0


@dataclass(frozen=True)
class Linking:
    """`mem`: frames a particle may be missing; `good`: least observations of a track that is kept."""

    maxdisp: float = 10.0
    mem: int = 10
    good: int = 10
    dim: int = 3
    min_size: float | None = None
    max_size: float | None = None


@dataclass(frozen=True)
class Settings:
    image_pattern: str = ""
    output: str = ""
    start: int = 0
    stop: int = 0
    step: int = 1
    background_start: int = 0
    background_stop: int = 0
    other: dict[str, object] = field(default_factory=dict)
    optics: Optics = field(default_factory=Optics)
    solver: Solver = field(default_factory=Solver)
    segmentation: Segmentation = field(default_factory=Segmentation)
    linking: Linking = field(default_factory=Linking)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        got = json.loads(text)
        parts = {"optics": Optics, "solver": Solver, "segmentation": Segmentation, "linking": Linking}
        known = {f.name for f in fields(cls)}
        return cls(**{k: _made(parts[k], v) if k in parts else v for k, v in got.items() if k in known})


def _made(kind, values: dict):
    return kind(**{f.name: values[f.name] for f in fields(kind) if f.name in values})


def read_coded(text: str) -> list[tuple[str, int, str]]:
    """Lines of name, numeric code and value; what follows % or # is a comment. Lines that aren't that are an error. `sources.parameters` knows what the codes are for."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        line = line.split("%")[0].split("#")[0].strip()
        if not line:
            continue
        parts = line.split(None, 2)
        if len(parts) < 3 or not parts[1].lstrip("-").isdigit():
            raise ValueError(f"line {n}: not a name, a code and a value: {line!r}")
        out.append((parts[0], int(parts[1]), parts[2]))
    return out


def write_coded(rows: list[tuple[str, int, str]]) -> str:
    return "".join(f"{name} {code} {value}\n" for name, code, value in rows)


def read_pairs(text: str, comments: bool = True) -> dict[str, str]:
    """Lines of key = value, trimmed; other lines are skipped, and with `comments` those that start with #."""
    out = {}
    for line in text.splitlines():
        key, mark, value = line.partition("=")
        if mark and key.strip() and not (comments and line.lstrip().startswith("#")):
            out[key.strip()] = value.strip()
    return out


def write_pairs(pairs: dict[str, object]) -> str:
    return "".join(f"{k} = {v}\n" for k, v in pairs.items())


def linking_from_pairs(pairs: dict[str, str]) -> Linking:
    """`memory` is read as `mem`, which is what it means."""
    named = {"mem": pairs.get("mem", pairs.get("memory"))} | {k: pairs.get(k) for k in ("maxdisp", "good", "dim", "min_size", "max_size")}
    kinds = {"mem": int, "good": int, "dim": int, "maxdisp": float, "min_size": float, "max_size": float}
    return Linking(**{k: kinds[k](float(v)) for k, v in named.items() if v is not None})
