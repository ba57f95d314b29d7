"""Intermediate tables in the folder that the cluster shares."""

from tessera.storage import shared_dir, stash

__all__ = ["shared_dir", "stash"]
