"""Synthetic tables as pure functions of a row index, a column path and a seed: results don't depend on partitions."""

from .generators import build, register_generator
from .infer import TableGenerator, generate_tables

__all__ = ["TableGenerator", "build", "generate_tables", "register_generator"]
