"""Settings from names and texts, as an environment has them."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

#: Words for true and false, and nanoseconds of the units of a duration.
TRUE, FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")
UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}


def parse_int(name: str, text: str) -> int:
    if not re.fullmatch(r"[+-]?[0-9]+", text.strip()):
        raise ValueError(f"{name} has to be a whole number, not {text!r}")
    return int(text)


def parse_bool(name: str, text: str) -> bool:
    if text.strip() not in TRUE + FALSE:
        raise ValueError(f"{name} has to be true or false, not {text!r}")
    return text.strip() in TRUE


def parse_duration(name: str, text: str) -> int:
    """Nanoseconds of a duration such as ``1h30m`` or ``-1.5s``; only zero goes without a unit."""
    text = text.strip()
    sign, rest = (-1 if text.startswith("-") else 1), text.lstrip("+-") if text[:2] not in ("--", "++", "+-", "-+") else "?"
    if rest == "0":
        return 0
    parts = re.findall(r"([0-9]*\.?[0-9]*)(ns|us|µs|ms|s|m|h)", rest)
    if not parts or "".join(n + u for n, u in parts) != rest or any(not re.search("[0-9]", n) for n, _ in parts):
        raise ValueError(f"{name} has to be a duration, not {text!r}")
    return sign * sum(round(float(n) * UNITS[u]) for n, u in parts)


def parse_peers(name: str, text: str) -> dict[str, str]:
    """``id=address`` entries, separated by commas; one at least."""
    out = {}
    for entry in filter(None, map(str.strip, text.split(","))):
        id_, sign, address = entry.partition("=")
        if not sign or not id_ or not address:
            raise ValueError(f"{name}: {entry!r} has to be id=address")
        out[id_.strip()] = address.strip()
    if not out:
        raise ValueError(f"{name} has to list one id=address at least")
    return out


@dataclass
class EngineSettings:
    """What an engine is told; `check` says what is wrong with it."""

    data_dir: str = "./data"
    sync_writes: bool = True
    max_key_bytes: int = 64 << 10
    max_value_bytes: int = 1 << 20
    memtable_max_bytes: int = 64 << 20
    block_cache_bytes: int = 8 << 20
    compaction_min_threshold: int = 4
    log_level: str = "info"
    log_format: str = "json"

    @classmethod
    def read(cls, environment: dict[str, str], prefix: str = "TIDEMARK_") -> EngineSettings:
        """The defaults, with what the environment sets by ``PREFIX_NAME``; checked."""
        out = cls()
        for f in fields(cls):
            name = prefix + f.name.upper()
            if name in environment:
                text, default = environment[name], getattr(out, f.name)
                read = parse_bool if isinstance(default, bool) else parse_int if isinstance(default, int) else None
                setattr(out, f.name, read(name, text) if read else text.lower() if f.name.startswith("log_") else text)
        out.check()
        return out

    def check(self) -> None:
        if not self.data_dir.strip():
            raise ValueError("data_dir is empty")
        for name in ("max_key_bytes", "max_value_bytes", "memtable_max_bytes", "block_cache_bytes"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} has to be above zero, not {getattr(self, name)}")
        if self.compaction_min_threshold < 2:
            raise ValueError(f"compaction_min_threshold has to be two at least, not {self.compaction_min_threshold}")
        for name, allowed in (("log_level", ("debug", "info", "warn", "error")), ("log_format", ("json", "text"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} has to be one of {', '.join(allowed)}, not {getattr(self, name)!r}")
