"""Which column plays which part in a sample table."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TableRoles:
    """Column roles; operators take names from here instead of hard-coding them."""

    key: tuple[str, ...] = ()
    features: tuple[str, ...] = ()
    composition: tuple[str, ...] = ()
    target: str | None = None
    source: str | None = None
    extras: tuple[str, ...] = field(default=())

    @property
    def numeric(self) -> tuple[str, ...]:
        """Features and composition, then the target when there is one."""
        tail = (self.target,) if self.target else ()
        return self.features + self.composition + tail
