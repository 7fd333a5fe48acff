"""Limits of what is read from sources, and options of the library; checked when they are made, never later."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

KIB, MIB, GIB = 2**10, 2**20, 2**30


class ConfigError(ValueError):
    """An option that can't hold. field and value say which."""

    def __init__(self, field: str, value, why: str):
        super().__init__(f"{field}={value!r}: {why}")
        self.field, self.value = field, value


@dataclass(frozen=True)
class ReadLimits:
    """Most that is read, per record, file and archive. Reaching a limit is fine, exceeding it isn't."""

    jsonl_record_bytes: int = 64 * MIB
    jsonl_source_bytes: int = 4 * GIB
    jsonl_record_count: int = 2_000_000
    sqlite_page_rows: int = 256
    sqlite_page_bytes: int = 256 * MIB
    sqlite_value_bytes: int = 128 * MIB
    sqlite_row_count: int = 5_000_000
    sqlite_decoded_bytes: int = 8 * GIB
    zip_compressed_bytes: int = 16 * GIB
    zip_entry_count: int = 65_536
    zip_entry_bytes: int = 8 * GIB
    zip_aggregate_bytes: int = 16 * GIB
    zip_compression_ratio: int = 200

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, bool) or not isinstance(v, int) or not 0 < v < 2**53:
                raise ConfigError(f.name, v, "must be a positive integer")
        for small, large in (("jsonl_record_bytes", "jsonl_source_bytes"), ("sqlite_page_rows", "sqlite_row_count"), ("sqlite_value_bytes", "sqlite_page_bytes"), ("sqlite_page_bytes", "sqlite_decoded_bytes"), ("zip_entry_bytes", "zip_aggregate_bytes")):
            if getattr(self, small) > getattr(self, large):
                raise ConfigError(small, getattr(self, small), f"must not be above {large}")

    @classmethod
    def of(cls, **changes) -> ReadLimits:
        unknown = changes.keys() - {f.name for f in fields(cls)}
        if unknown:
            raise ConfigError(min(unknown), changes[min(unknown)], "unknown field")
        return replace(cls(), **changes)


def parse_limits(assignments: list[str]) -> ReadLimits:
    """Limits from texts field=N, N with KiB, MiB or GiB behind it if wanted; each field once."""
    names = {re.sub("_", "", f.name): f.name for f in fields(ReadLimits)}
    found: dict[str, int] = {}
    for a in assignments:
        m = re.fullmatch(r"([A-Za-z_]+)=(\d+)(KiB|MiB|GiB)?", a)
        if not m:
            raise ConfigError("source_limit", a, "must be field=number")
        name = names.get(re.sub("_", "", m[1]).lower())
        if name is None:
            raise ConfigError(m[1], m[2], "unknown field")
        if name in found:
            raise ConfigError(name, m[2], "given twice")
        found[name] = int(m[2]) * {None: 1, "KiB": KIB, "MiB": MIB, "GiB": GIB}[m[3]]
    return ReadLimits.of(**found)


@dataclass(frozen=True)
class Options:
    """Options of a call: limit None means all, context is in lines."""

    limit: int | None = None
    offset: int = 0
    context: int = 0
    workspace: str | None = None
    message_types: tuple[str, ...] = ()
    include_cross_workspace: bool = False

    def __post_init__(self):
        whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
        if self.limit is not None and (not whole(self.limit) or self.limit < 1):
            raise ConfigError("limit", self.limit, "must be 1 or more")
        for f in ("offset", "context"):
            if not whole(getattr(self, f)) or getattr(self, f) < 0:
                raise ConfigError(f, getattr(self, f), "must be 0 or more")
        if self.workspace is not None and (not isinstance(self.workspace, str) or not self.workspace or re.search(r"[\r\n\0]", self.workspace)):
            raise ConfigError("workspace", self.workspace, "must be one line")
