"""Conversion settings from a TOML file: sections flow, surface, solid and postprocess, each optional.

Settings of the older command-line tool are read as well, see ``OLDER``.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path


class ConfigError(ValueError):
    """Settings that are missing, of the wrong type, or contradict each other."""


@dataclass(frozen=True)
class FlowConfig:
    input_dir: str
    output_dir: str = "flow_output"
    stride: int = 1
    dt: float = 0.0


@dataclass(frozen=True)
class SurfaceConfig:
    geometry_dir: str
    data_dir: str
    output_dir: str = "surface_output"
    stride: int = 1
    dt: float = 0.0


@dataclass(frozen=True)
class SolidConfig:
    input_dir: str
    output_dir: str = "solid_output"
    voxel_size: float = 1.0
    stride: int = 1
    dt: float = 0.0


@dataclass(frozen=True)
class PostprocessConfig:
    sync: bool = True
    archive: bool = False
    output_dir: str = "."
    plots: bool = False


@dataclass(frozen=True)
class Config:
    flow: FlowConfig | None = None
    surface: SurfaceConfig | None = None
    solid: SolidConfig | None = None
    postprocess: PostprocessConfig = field(default_factory=PostprocessConfig)


SECTIONS = {"flow": FlowConfig, "surface": SurfaceConfig, "solid": SolidConfig, "postprocess": PostprocessConfig}
#: Names of settings in files of the older tool, and ours.
OLDER = {
    "flow": {"flow_dir": "input_dir", "flow_dt": "dt", "step": "stride"},
    "surface": {"surf_data_dir": "data_dir", "surf_geom_dir": "geometry_dir", "surface_dt": "dt", "step": "stride"},
    "solid": {"solid_dir": "input_dir", "solid_dt": "dt", "step": "stride"},
    "postprocess": {"sync_enabled": "sync", "vis_enabled": "plots"},
}
TYPES = {"str": str, "int": int, "float": (int, float), "bool": bool}


def _section(name: str, values: dict):
    kind = SECTIONS[name]
    known = {f.name: f for f in fields(kind)}
    older = OLDER[name]
    if twice := {older[k] for k in older if k in values} & set(values):
        raise ConfigError(f"[{name}] has settings by both their names: {', '.join(sorted(twice))}")
    values = {older.get(k, k): v for k, v in values.items()}
    if unknown := set(values) - set(known):
        raise ConfigError(f"[{name}] has unknown settings: {', '.join(sorted(unknown))}")
    for key, value in values.items():
        wanted = TYPES[known[key].type]
        if not isinstance(value, wanted) or isinstance(value, bool) and wanted is not bool:
            raise ConfigError(f"[{name}] {key} must be of type {known[key].type}")
    try:
        made = kind(**values)
    except TypeError as e:
        raise ConfigError(f"[{name}] lacks a setting: {e}") from None
    if getattr(made, "stride", 1) < 1 or getattr(made, "voxel_size", 1.0) <= 0 or getattr(made, "dt", 0.0) < 0:
        raise ConfigError(f"[{name}] stride and voxel_size must be positive, dt not negative")
    return made


def load(path: str | Path) -> Config:
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    if unknown := set(raw) - set(SECTIONS):
        raise ConfigError(f"unknown sections: {', '.join(sorted(unknown))}")
    if not set(raw) & {"flow", "surface", "solid"}:
        raise ConfigError("nothing to convert: no section flow, surface or solid")
    return Config(**{name: _section(name, values) for name, values in raw.items()})
