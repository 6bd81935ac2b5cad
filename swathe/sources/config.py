"""Run configuration in TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path


class MissingInput(FileNotFoundError):
    """An input that the configuration names does not exist, or a needed one is not named."""


@dataclass(frozen=True)
class RunInputs:
    """Paths are relative to the configuration's folder; unknown keys are ignored."""

    rgb: Path | None = None
    gli_classes: Path | None = None
    lidar: dict[str, Path] = field(default_factory=dict)
    trajectory: dict[str, Path] = field(default_factory=dict)
    waypoints: dict[str, Path] = field(default_factory=dict)
    output_dir: Path = Path("output")
    track_spacing_m: float = 40.0
    altitude_m: float = 60.0
    vmin: float = 2.0
    vmax: float = 8.0
    kernel: str = "gaussian"
    stride: int = 8
    nsample: int = 2000
    kmin: int = 2
    kmax: int = 12
    seed: int = 6213
    tree_labels: tuple[int, ...] = (1,)
    gli_class_codes: dict[str, int] = field(default_factory=lambda: {"field": 2, "decid": 0, "conif": 1})


def load_inputs(path: str | Path) -> RunInputs:
    path = Path(path)
    with path.open("rb") as f:
        raw = tomllib.load(f)
    at = path.parent
    place = lambda v: at / v if v else None
    paths, plan = raw.get("paths", {}), dict(raw.get("planning", {}))
    if "track_spacing_m" not in plan and "flightlines_spacing_m" in plan:
        plan["track_spacing_m"] = plan["flightlines_spacing_m"]
    known = {f.name for f in fields(RunInputs)}
    values = {k: v for k, v in plan.items() if k in known}
    if "tree_labels" in values:
        values["tree_labels"] = tuple(values["tree_labels"])
    for name in ("rgb", "gli_classes"):
        values[name] = place(paths.get(name))
    for name in ("lidar", "trajectory", "waypoints"):
        values[name] = {k: at / v for k, v in paths.get(name, {}).items() if v}
    if paths.get("output_dir"):
        values["output_dir"] = at / paths["output_dir"]
    if "gli_class_codes" in raw:
        values["gli_class_codes"] = {k: int(v) for k, v in raw["gli_class_codes"].items()}
    return RunInputs(**values)


def validate(inputs: RunInputs, require_lidar: bool = False, require_gli: bool = False) -> RunInputs:
    """A path that is set must exist; an unset one is fine unless it is required."""
    named = {"rgb": inputs.rgb, "gli_classes": inputs.gli_classes}
    for group in ("lidar", "trajectory", "waypoints"):
        named |= {f"{group}.{k}": v for k, v in getattr(inputs, group).items()}
    gone = [f"{k}: {v}" for k, v in named.items() if v is not None and not v.exists()]
    if gone:
        raise MissingInput("missing inputs: " + "; ".join(gone))
    if require_lidar and not inputs.lidar:
        raise MissingInput("no LiDAR file is named")
    if require_gli and inputs.gli_classes is None:
        raise MissingInput("no class raster is named")
    return inputs


def resolve(configured: Path | None, bundled: Path | None) -> Path:
    """The configured file, else the bundled one, else an error."""
    for p in (configured, bundled):
        if p is not None and p.exists():
            return p
    raise MissingInput(f"neither {configured} nor {bundled} exists")


def template() -> str:
    """A configuration to fill in."""
    lines = ["[paths]", 'rgb = ""', 'gli_classes = ""', 'output_dir = "output"', "", "[paths.lidar]", "", "[paths.trajectory]", "", "[paths.waypoints]", "", "[planning]"]
    skip = {"rgb", "gli_classes", "lidar", "trajectory", "waypoints", "output_dir", "gli_class_codes"}
    for f in fields(RunInputs):
        if f.name not in skip:
            v = f.default
            lines.append(f"{f.name} = " + (f'"{v}"' if isinstance(v, str) else str(list(v)) if isinstance(v, tuple) else str(v)))
    lines += ["", "[gli_class_codes]", *[f"{k} = {v}" for k, v in RunInputs().gli_class_codes.items()]]
    return "\n".join(lines) + "\n"
