"""Capture of row-level changes from tables, and their delivery, on Spark."""

from rowtide.model import Position, TableRef, TableSpec

__all__ = ["Position", "TableRef", "TableSpec"]
