"""Column layout: order and visibility."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from tidemark.plans.nodes import Sort


@dataclass(frozen=True)
class Layout:
    order: tuple[str, ...] = ()
    hidden: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def initial(cls, null_counts: Mapping[str, int], total_rows: int) -> "Layout":
        """Columns without a single value start hidden."""
        return cls(tuple(null_counts), frozenset(c for c, n in null_counts.items() if n >= total_rows))

    def ordered(self, columns: Iterable[str]) -> list[str]:
        """The saved order without columns that are gone; new columns last."""
        columns = list(columns)
        known = [c for c in self.order if c in columns]
        return known + [c for c in columns if c not in self.order]

    def visible(self, columns: Iterable[str]) -> list[str]:
        return [c for c in self.ordered(columns) if c not in self.hidden]

    def toggle(self, column: str) -> "Layout":
        return replace(self, hidden=self.hidden ^ {column})

    def show_all(self) -> "Layout":
        return replace(self, hidden=frozenset())

    def hide_all(self, columns: Iterable[str]) -> "Layout":
        return replace(self, hidden=frozenset(columns))

    def move(self, columns: Iterable[str], source: int, target: int) -> "Layout":
        """The column at ``source`` goes to ``target``."""
        now = self.ordered(columns)
        now.insert(target, now.pop(source))
        return replace(self, order=tuple(now))


def sorts_from_columns(states: Iterable[Mapping]) -> list[Sort]:
    """Grid column states (column, sort, sort_index) as a sort list: by sort_index, without the unsorted."""
    sorted_ones = [s for s in states if s.get("sort")]
    return [Sort(s["column"], s["sort"] == "desc") for s in sorted(sorted_ones, key=lambda s: s.get("sort_index") or 0)]
