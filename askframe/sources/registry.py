"""Registered databases (paths or JDBC URLs, never passwords) in a JSON file."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from pathlib import Path


@dataclass
class Database:
    name: str
    path: str
    schema_file: str = ""
    dialect: str = "spark"
    username: str = ""
    table_count: int = 0
    is_active: bool = False
    created_at: str = ""
    updated_at: str = ""


def safe_name(name: str) -> str:
    """A name that can be a file's: other characters become underscores."""
    return re.sub(r"[^A-Za-z0-9._-]", "_", name) or "db"


class Registry:
    """At most one database is active; the first to come becomes so."""

    def __init__(self, path: str):
        self.path = Path(path)

    def _read(self) -> list[Database]:
        if not self.path.exists():
            return []
        known = set(Database.__dataclass_fields__)
        return [Database(**{k: v for k, v in d.items() if k in known}) for d in json.loads(self.path.read_text())]

    def _write(self, rows: list[Database]) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps([asdict(d) for d in rows], indent=1))

    def list(self) -> list[Database]:
        """The active one first, then by name."""
        return sorted(self._read(), key=lambda d: (not d.is_active, d.name))

    def get(self, name: str) -> Database | None:
        return next((d for d in self._read() if d.name == name), None)

    def active(self) -> Database | None:
        return next((d for d in self._read() if d.is_active), None)

    def insert(self, db: Database) -> Database:
        rows = self._read()
        if any(d.name == db.name for d in rows):
            raise ValueError(f"database {db.name!r} exists")
        db.created_at = db.updated_at = datetime.now(timezone.utc).isoformat(timespec="seconds")
        db.is_active = not rows
        self._write([*rows, db])
        return db

    def set_table_count(self, name: str, n: int) -> None:
        rows = self._read()
        for d in rows:
            if d.name == name:
                d.table_count, d.updated_at = n, datetime.now(timezone.utc).isoformat(timespec="seconds")
        self._write(rows)

    def activate(self, name: str) -> bool:
        rows = self._read()
        if not any(d.name == name for d in rows):
            return False
        for d in rows:
            d.is_active = d.name == name
        self._write(rows)
        return True

    def delete(self, name: str) -> bool:
        rows = self._read()
        self._write([d for d in rows if d.name != name])
        return any(d.name == name for d in rows)
