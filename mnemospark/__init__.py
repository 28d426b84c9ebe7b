"""Spark-first engine for project memory: validated writes, ranked retrieval and hand-offs as DataFrame plans."""

__version__ = "0.1.0"
