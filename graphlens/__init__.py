"""graphlens: a PySpark engine for typed property graphs of source code."""

__version__ = "0.1.0"
