"""The record of a store's live runs: one JSON file per version, published whole; the highest number holds."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from stratalog.sources.files import Files


@dataclass(frozen=True)
class Run:
    name: str
    level: int
    number: int
    rows: int
    bytes: int
    min_key: str  # hexadecimal
    max_key: str
    min_seq: int
    max_seq: int

    def may_hold(self, lo: bytes | None, hi: bytes | None, snapshot: int | None) -> bool:
        """False if no row of the run lies in the range at the snapshot."""
        return not (
            (lo is not None and bytes.fromhex(self.max_key) < lo) or (hi is not None and bytes.fromhex(self.min_key) >= hi) or (snapshot is not None and self.min_seq > snapshot)
        )


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    last_seq: int = 0
    flushed_seq: int = 0
    history_floor: int = 0
    next_run: int = 0
    runs: tuple[Run, ...] = ()
    streams: dict[str, int] = field(default_factory=dict)

    def levels(self) -> dict[int, list[Run]]:
        out: dict[int, list[Run]] = {}
        for run in sorted(self.runs, key=lambda r: (r.level, r.number)):
            out.setdefault(run.level, []).append(run)
        return out

    def changed(self, **changes) -> Manifest:
        return replace(self, version=self.version + 1, **changes)


def _name(version: int) -> str:
    return f"manifest/{version:020d}.json"


def publish(files: Files, manifest: Manifest) -> Manifest:
    files.publish(_name(manifest.version), json.dumps(asdict(manifest)).encode())
    return manifest


def versions(files: Files) -> list[int]:
    return [int(n[:20]) for n in files.names("manifest") if n.endswith(".json") and n[:20].isdigit()]


def load(files: Files, version: int | None = None) -> Manifest | None:
    """The newest one, or that of a version; None in an empty folder. A damaged file raises."""
    found = versions(files)
    if not found:
        return None
    data = json.loads(files.read(_name(max(found) if version is None else version)))
    return Manifest(**data | {"runs": tuple(Run(**r) for r in data["runs"])})
