"""Names of tables, what is known about them, and how far they have been read."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class TableRef:
    database: str
    table: str
    catalog: str = ""
    schema: str = ""

    @property
    def identifier(self) -> str:
        """Quoted SQL name; an empty catalog or schema is left out."""
        return ".".join(f"`{p}`" for p in (self.catalog, self.schema, self.table) if p)

    @property
    def full_name(self) -> str:
        return f"{self.database}/{self.identifier}"


@dataclass(frozen=True)
class TableSpec:
    """A table with a commit timestamp column and a total order of the rows of one commit.

    ``hint`` is accepted and ignored: files have no secondary index to force.
    """

    ref: TableRef
    commit_ts: str
    primary_key: tuple[str, ...]
    change_set_column: str | None = None
    hint: str = ""

    @property
    def order(self) -> list[str]:
        return [self.commit_ts, *self.primary_key]


@dataclass(frozen=True)
class Position:
    """Everything up to ``ts``, and of the rows at ``ts`` those up to ``key``, has been seen.

    Without a key the whole commit at ``ts`` has been seen.  Keeping the key lets a
    batch end inside a commit and a restart go on there.
    """

    ts: Any
    key: tuple | None = None

    def __le__(self, other: Position) -> bool:
        if self.ts != other.ts:
            return self.ts < other.ts
        # No key stands for the end of the commit.
        nulls_first = lambda key: [(v is not None, v) for v in key]
        return other.key is None or (self.key is not None and nulls_first(self.key) <= nulls_first(other.key))


#: Reads a table from its first row; rows without a commit timestamp are never seen.
EARLIEST = Position(None)
