"""graphloom: compile documents, API descriptions and tables into a typed,
evidence-carrying knowledge graph held in Spark DataFrames, and query it."""

from graphloom.schema import Graph
from graphloom.session import configure

__all__ = ["Graph", "configure"]
