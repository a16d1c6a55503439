"""Configuration: defaults, validation with a list of errors, lookup by dotted path, discovery."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from .operators.scoring import REQUIREMENTS, requirements

FILE_NAMES = ("doclattice.config.json", ".doclatticerc.json")
MODES = ("presence", "typecheck", "run")


@dataclass
class DocsConfig:
    include: list[str] = field(default_factory=lambda: ["README.md", *(f"{folder}/**/*.{kind}" for folder in ("docs", "content") for kind in ("md", "mdx"))])
    exclude: list[str] = field(default_factory=list)
    map: str | None = None


@dataclass
class Config:
    entry: str | None = None
    minimum: int = 0
    lint: bool = True
    ratchet: bool = False
    style: str = "minimal"
    require: dict[str, bool] = field(default_factory=dict)
    docs: DocsConfig = field(default_factory=DocsConfig)
    max_depth: int = 4
    use_cache: bool = True
    follow_imports: bool = True

    def requirements(self) -> dict[str, bool]:
        return requirements(self.style, **self.require)


def errors(raw: Any) -> list[str]:
    """What is wrong with a raw configuration; empty if nothing is."""
    if not isinstance(raw, dict):
        return ["the configuration must be an object"]
    out = []
    kinds = {"entry": str, "minimum": int, "lint": bool, "ratchet": bool, "style": str, "require": dict, "docs": dict, "max_depth": int, "use_cache": bool, "follow_imports": bool}
    for key, value in raw.items():
        if key not in kinds:
            out.append(f"unknown key {key}")
        elif value is not None and (not isinstance(value, kinds[key]) or (kinds[key] is int and isinstance(value, bool))):
            out.append(f"{key} must be {kinds[key].__name__}")
    if isinstance(raw.get("minimum"), int) and not 0 <= raw["minimum"] <= 100:
        out.append("minimum must be from 0 to 100")
    if isinstance(raw.get("style"), str) and raw["style"] not in REQUIREMENTS:
        out.append(f"style must be one of {', '.join(REQUIREMENTS)}")
    if isinstance(raw.get("docs"), dict):
        out += [f"docs.{k} must be a list of texts" for k in ("include", "exclude") if k in raw["docs"] and not (isinstance(raw["docs"][k], list) and all(isinstance(x, str) for x in raw["docs"][k]))]
    return out


def merge(*layers: dict[str, Any] | None) -> Config:
    """Later layers win, key by key; errors are raised together."""
    values: dict[str, Any] = {}
    for layer in layers:
        if layer:
            bad = errors(layer)
            if bad:
                raise ValueError("; ".join(bad))
            for k, v in layer.items():
                values[k] = {**values.get(k, {}), **v} if isinstance(v, dict) and isinstance(values.get(k), dict) else v
    docs = values.pop("docs", None)
    return Config(**values, docs=DocsConfig(**docs) if docs else DocsConfig())


def find(start: str | Path, override: str | None = None, fallback: str | Path | None = None) -> Config:
    """The configuration of a folder: the file named, else the nearest on the way up, else the fallback, else defaults."""
    if override:
        return merge(json.loads(Path(override).read_text()))
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        for name in FILE_NAMES:
            if (folder / name).is_file():
                return merge(json.loads((folder / name).read_text()))
        manifest = folder / "package.json"
        if manifest.is_file() and isinstance(own := json.loads(manifest.read_text()).get("doclattice"), dict):
            return merge(own)
    if fallback and Path(fallback).is_file():
        return merge(json.loads(Path(fallback).read_text()))
    return Config()


def nested(config: dict[str, Any], path: str, default: Any = None) -> Any:
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def with_value(config: dict[str, Any], path: str, value: Any) -> dict[str, Any]:
    """A copy with one value set; objects on the way are made."""
    head, _, rest = path.partition(".")
    inner = config.get(head)
    return config | {head: with_value(inner if isinstance(inner, dict) else {}, rest, value) if rest else value}


def coerce(text: str) -> Any:
    """Text of a command line as the scalar that it looks like."""
    if text in ("true", "false"):
        return text == "true"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            return text


def flatten(config: dict[str, Any], prefix: str = "") -> list[tuple[str, Any]]:
    """(dotted key, value) rows."""
    out: list[tuple[str, Any]] = []
    for k, v in config.items():
        out += flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else [(prefix + k, v)]
    return out


def as_rows(config: Config) -> list[tuple[str, str]]:
    return [(k, json.dumps(v)) for k, v in flatten(asdict(config))]


def validation_modes(flag: bool | str | None) -> list[str]:
    """``--examples`` as modes in order: on is all, a list picks, off and nothing are none."""
    if flag in (None, False, "", "false"):
        return []
    if flag in (True, "true", "all"):
        return list(MODES)
    chosen = [x.strip() for x in str(flag).split(",") if x.strip()]
    unknown = [x for x in chosen if x not in MODES]
    if unknown:
        raise ValueError(f"unknown mode {', '.join(unknown)}")
    return [m for m in MODES if m in chosen]


def project_root(start: str | Path) -> Path:
    """The nearest folder up the way with a manifest or repository; the start where there is none."""
    at = Path(start).resolve()
    return next((f for f in (at, *at.parents) if (f / "package.json").is_file() or (f / ".git").exists()), at)
