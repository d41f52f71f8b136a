"""Session state as JSON, its history on disk, and the key a dataset's side files are kept under."""

from __future__ import annotations

import json
import re
import time
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from tidemark.plans.layout import Layout
from tidemark.plans.nodes import Aggregation, Filter, Op, Sort
from tidemark.sources.sidefiles import LocalFiles, SharedFiles

VERSION = 1
HISTORY = 3
RETENTION_S = 21 * 86_400


def _slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.strip().lower()).removeprefix("-").removesuffix("-")[:64]


def storage_key(name: str | None, size: float | None, modified: float | None) -> str:
    """``slug-size-mtime``; figures are whole and not below zero, a blank name is ``dataset``."""
    whole = lambda x: max(0, int(x)) if isinstance(x, (int, float)) and x == x and abs(x) != float("inf") else 0
    return f"{_slug(name or '') or 'dataset'}-{whole(size)}-{whole(modified)}"


@dataclass(frozen=True)
class SessionState:
    filters: tuple[Filter, ...] = ()
    sorts: tuple[Sort, ...] = ()
    group_by: tuple[str, ...] = ()
    aggregations: tuple[Aggregation, ...] = ()
    layout: Layout = field(default_factory=Layout)
    search: str = ""
    search_case_sensitive: bool = False

    def to_json(self) -> str:
        state = asdict(self)
        state["layout"] = {"order": list(self.layout.order), "hidden": sorted(self.layout.hidden)}
        return json.dumps({"version": VERSION, "state": state}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> "SessionState":
        envelope: dict[str, Any] = json.loads(text)
        if envelope.get("version") != VERSION:
            raise ValueError("unsupported session version")
        s = envelope["state"]
        return cls(
            tuple(Filter(**{**f, "op": Op(f["op"])}) for f in s["filters"]),
            tuple(Sort(**x) for x in s["sorts"]),
            tuple(s["group_by"]),
            tuple(Aggregation(**a) for a in s["aggregations"]),
            Layout(tuple(s["layout"]["order"]), frozenset(s["layout"]["hidden"])),
            s["search"],
            s["search_case_sensitive"],
        )


class SessionFolder:
    """``latest.json`` and the newest history files of one dataset; older than the retention are dropped.

    ``files`` is the driver's disk, or with ``SharedFiles(spark)`` the file system of the cluster.
    """

    def __init__(self, folder: str | Path, files: LocalFiles | SharedFiles | None = None):
        self.folder = str(folder)
        self.files = files or LocalFiles()

    def _history(self) -> list[str]:
        return [n for n in self.files.names(self.folder) if n.startswith("history-") and n.endswith(".json")]

    def save(self, state: SessionState, now: float | None = None) -> None:
        now = time.time() if now is None else now
        text = state.to_json()
        for name in (f"history-{int(now * 1000):015d}.json", "latest.json"):
            self.files.write(f"{self.folder}/{name}", text)
        history = self._history()
        for old in history:
            made = int(old.removeprefix("history-").removesuffix(".json")) / 1000
            if old in history[:-HISTORY] or now - made > RETENTION_S:
                self.files.remove(f"{self.folder}/{old}")

    def load(self) -> SessionState | None:
        """The latest state that can be read."""
        for name in ("latest.json", *reversed(self._history())):
            try:
                text = self.files.read(f"{self.folder}/{name}")
                if text is not None:
                    return SessionState.from_json(text)
            except (OSError, ValueError, KeyError, TypeError):
                continue
        return None


#: What is dropped first when side files outgrow their quota; within a class the oldest goes first.
QUOTA_BYTES = 200 * 1024 * 1024
QUOTA_ORDER = ("row-cache", "row-index", "annotations", "sessions")


def over_quota(entries: list[tuple[str, str, int, float]], quota: int = QUOTA_BYTES) -> list[str]:
    """Which of (name, class, bytes, last used) to drop until the rest fits the quota."""
    total, gone = sum(e[2] for e in entries), []
    for name, _, size, _ in sorted(entries, key=lambda e: (QUOTA_ORDER.index(e[1]) if e[1] in QUOTA_ORDER else len(QUOTA_ORDER), e[3])):
        if total <= quota:
            break
        gone.append(name)
        total -= size
    return gone
