"""Engine options from a TOML file and command-line flags; flags win."""

from __future__ import annotations

import argparse
import os
import tomllib

from strata.engine import OPTIONS
from strata.errors import InvalidRequest

FILE_VARIABLE = "STRATA_CONFIG"


def options(argv: list[str] | None = None, environment: dict | None = None) -> dict:
    """``dir``, ``host``, ``port`` and the engine's options. The environment may name the file."""
    environment = os.environ if environment is None else environment
    found = {"dir": "./strata-data", "host": "127.0.0.1", "port": 3841} | OPTIONS
    if path := environment.get(FILE_VARIABLE):
        with open(path, "rb") as f:
            given = tomllib.load(f)
        if unknown := set(given) - set(found):
            raise InvalidRequest(f"unknown options in {path}: {sorted(unknown)}")
        found |= given
    parser = argparse.ArgumentParser()
    for name, value in found.items():
        parser.add_argument(f"--{name.replace('_', '-')}", type=type(value), default=None)
    flags = vars(parser.parse_args(argv or []))
    return found | {k: v for k, v in flags.items() if v is not None}
