"""Readers and writers."""

from .tables import TABLES, read, register, scratch

__all__ = ["TABLES", "read", "register", "scratch"]
