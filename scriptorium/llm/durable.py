"""Checkpoints of this subpackage's operators."""

from scriptorium.durable import checkpoint, shared_folder

__all__ = ["checkpoint", "shared_folder"]
