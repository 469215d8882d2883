"""Reading, writing and inspecting files."""

from .files import inspect, read_input, write_output

__all__ = ["inspect", "read_input", "write_output"]
