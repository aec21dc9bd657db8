"""Cutting lineage through the folder that all executors share."""

from tidemark.operators.storage import cut, drop, forget, shared_dir

__all__ = ["cut", "drop", "forget", "shared_dir"]
