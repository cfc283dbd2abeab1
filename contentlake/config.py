"""Settings: a YAML file, over which four environment variables go."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

import yaml

ENVIRONMENT = {"CONTENTLAKE_PATH": "path", "CONTENTLAKE_DEVICE": "device", "CONTENTLAKE_PARALLEL": "parallel", "CONTENTLAKE_HUB": "hub"}


@dataclass(frozen=True)
class Config:
    path: str = "archive"
    device: str = "local"
    hub: str = ""
    parallel: int = 16
    max_body_bytes: int = 8 * 1024 * 1024
    interval_s: int = 1800
    pull_limit: int = 2000
    push_limit: int = 500
    snapshot_chunk: int = 5000

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """Unknown keys are an error; values take the field's type."""
        given = (yaml.safe_load(Path(path).read_text()) or {}) if path else {}
        given |= {name: os.environ[var] for var, name in ENVIRONMENT.items() if var in os.environ}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if unknown := set(given) - set(kinds):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: kinds[k](v) for k, v in given.items()})
