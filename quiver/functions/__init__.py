"""The functions of the language, by namespace."""

from quiver.functions import lists, maps, numbers, others, strings, temporal
from quiver.functions.registry import ALIASES, FUNCTIONS

__all__ = ["ALIASES", "FUNCTIONS", "lists", "maps", "numbers", "others", "strings", "temporal"]
