"""Scans (file keys, schema guard, null tokens), the file catalogue, record rescue, the versions' commit log, and sinks (reports, partitions)."""

from . import catalogue, files, rescue, versions

__all__ = ["catalogue", "files", "rescue", "versions"]
