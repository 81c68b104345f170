"""Structured Streaming entry points.

The reference has no streaming operators; its long-running step is answer
generation.  :func:`complete_stream` runs that step as an incremental,
restartable stream over a directory of prompt-grid files.
"""

from .incremental import complete_stream

__all__ = ["complete_stream"]
