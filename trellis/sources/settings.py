"""Settings from a TOML text: each field states its type, its default and the rule that its values keep."""

from __future__ import annotations

import socket
import string
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Any

_KEPT = frozenset(string.ascii_letters + string.digits + "_-")


def safe_name(name: str) -> str:
    """A machine's name as file names can carry it: what separates words is written _, and only what _KEPT has is left."""
    written = "".join("_" if c in ". " else c for c in name)
    return "".join(filter(_KEPT.__contains__, written)) or "unknown_machine"


@dataclass(frozen=True)
class Rule:
    """What values of a field are like, and a test for it."""

    like: str
    holds: Callable[[Any], bool]


def above(low: float, upto: float | None = None) -> Rule:
    like = f"a number above {low}" + (f", {upto} at most" if upto is not None else "")
    return Rule(like, lambda v: v > low and (upto is None or v <= upto))


FILLED = Rule("a text with at least one character", bool)
FILE_NAME = Rule("a text of letters, digits, _ and -", lambda v: bool(v) and set(v) <= _KEPT)


def kept(default: Any, rule: Rule) -> Any:
    source = {"default_factory": default} if callable(default) else {"default": default}
    return field(**source, metadata={"rule": rule})


# The default numbers and globs.
@dataclass(frozen=True)
class Drive:
    folder_name: str = kept("Trellis", FILLED)


@dataclass(frozen=True)
class Local:
    sync_dir: str = kept("~/Trellis", FILLED)


@dataclass(frozen=True)
class Engine:
    poll_interval_secs: int = kept(45, above(0))
    mass_delete_threshold: float = kept(0.25, above(0, 1))
    machine_name: str = kept(lambda: safe_name(socket.gethostname()), FILE_NAME)
    quarantine_retention_days: int = kept(30, above(0))
    ignore: tuple[str, ...] = ("*.tmp", "~$*", ".DS_Store", "Thumbs.db", "*.swp", ".trellis*")


@dataclass(frozen=True)
class Settings:
    drive: Drive = field(default_factory=Drive)
    local: Local = field(default_factory=Local)
    engine: Engine = field(default_factory=Engine)


def _typed(kind: str, value: Any) -> Any:
    """The value as a field of this kind holds it, None where it can't."""
    if kind == "str":
        return value if isinstance(value, str) else None
    if kind == "tuple[str, ...]":
        return tuple(value) if isinstance(value, list) and all(isinstance(x, str) for x in value) else None
    number = isinstance(value, int | float) and not isinstance(value, bool)
    return value if number and (kind == "float" or isinstance(value, int)) else None


def _built(of: type, given: dict[str, Any], at: str) -> Any:
    """An instance of a section from its table; every value is of its field's kind and keeps its field's rule."""
    known = {f.name: f for f in fields(of)}
    values = {}
    for key, value in given.items():
        where = f"{at}{key}"
        if key not in known:
            raise ValueError(f"{where}: there is no such setting; {', '.join(sorted(known))} can stand here")
        rule, typed = known[key].metadata.get("rule"), _typed(known[key].type, value)
        if typed is None or (rule and not rule.holds(typed)):
            raise ValueError(f"{where}: {value!r} is not {rule.like if rule else 'a list of texts'}")
        values[key] = typed
    return of(**values)


def settings(text: str) -> Settings:
    """The settings that a TOML text gives; what it doesn't name keeps its default."""
    sections = {f.name: f.default_factory for f in fields(Settings)}
    out = {}
    for name, given in tomllib.loads(text).items():
        if name not in sections or not isinstance(given, dict):
            raise ValueError(f"{name}: not one of the sections {', '.join(sorted(sections))}")
        out[name] = _built(sections[name], given, f"{name}.")
    return Settings(**out)
