"""DataFrame -> DataFrame operators."""

from . import align, contingency, coverage, generate, profile, reshape

__all__ = ["align", "contingency", "coverage", "generate", "profile", "reshape"]
