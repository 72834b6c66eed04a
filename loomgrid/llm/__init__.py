"""Operators for training text: top items of groups, token ids, packing, text quality."""

from loomgrid.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
