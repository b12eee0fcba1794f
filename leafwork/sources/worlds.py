"""Folders of the journal program: its data folder, its worlds, and where a world's files go. Driver-side only."""

from __future__ import annotations

import os
import re
import sys
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = re.compile(r"[\w.-]+")


class SettingsError(ValueError):
    """Settings that can't be used, told in words for the user."""


def data_folders() -> list[Path]:
    """Where the program keeps its data on this platform, likeliest first."""
    home = Path.home()
    if sys.platform == "win32":
        bases = [Path(p) for k in ("LOCALAPPDATA", "APPDATA") if (p := os.environ.get(k))]
    elif sys.platform == "darwin":
        bases = [home / "Library/Application Support"]
    else:
        bases = [Path(os.environ.get("XDG_DATA_HOME") or home / ".local/share"), home]
    return [b / n / "Data" for b in bases for n in ("FoundryVTT", "foundrydata")]


def default_data_dir() -> Path | None:
    return next((p for p in data_folders() if p.is_dir()), None)


def list_worlds(data_dir: str | Path) -> list[str]:
    """Names of the worlds, in order whatever their case; none if the folder can't be read."""
    try:
        return sorted((p.name for p in (Path(data_dir) / "worlds").iterdir() if p.is_dir()), key=str.casefold)
    except OSError:
        return []


def world_output_dir(data_dir: str | Path, world: str) -> Path:
    return Path(data_dir) / "worlds" / checked_world(world) / "leafwork"


def checked_world(world: str) -> str:
    if not _NAME.fullmatch(world):
        raise SettingsError(f"no world can be named {world!r}")
    return world


def output_and_prefix(slug: str, out: str | None, world: str | None, data_dir: str | None) -> tuple[str, str]:
    """Output folder and asset prefix: a world with a data folder takes precedence over ``out``."""
    prefix = f"worlds/{checked_world(world)}/leafwork/{slug}" if world else f"leafwork/{slug}"
    if world and data_dir:
        return str(world_output_dir(data_dir, world)), prefix
    return out or ".", prefix


def destinations(slug: Column, out: Column, world: Column, data_dir: Column) -> tuple[Column, Column, Column]:
    """The same for many conversions: output folder, asset prefix (both null where no world can be so named), and whether the name is allowed."""
    named = F.coalesce(world, F.lit("")) != ""
    allowed = ~named | world.rlike(f"(?U)^(?:{_NAME.pattern})$")
    prefix = F.when(named, F.concat(F.lit("worlds/"), world, F.lit("/leafwork/"), slug)).otherwise(F.concat(F.lit("leafwork/"), slug))
    folder = F.when(named & (F.coalesce(data_dir, F.lit("")) != ""), F.concat_ws("/", data_dir, F.lit("worlds"), world, F.lit("leafwork"))).otherwise(F.coalesce(F.nullif(out, F.lit("")), F.lit(".")))
    return F.when(allowed, folder), F.when(allowed, prefix), allowed
