"""Reading line files and writing results."""

from .lines import discover_csv, read_lines
from .sinks import write_parts, write_single

__all__ = ["discover_csv", "read_lines", "write_parts", "write_single"]
