"""Shared storage, as in the rest of the library."""

from ..storage import durable, few, located, remove, scratch, shared_root

__all__ = ["durable", "few", "located", "remove", "scratch", "shared_root"]
