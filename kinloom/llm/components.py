"""Connected components, as the graph operators make them."""

from kinloom.operators.graph import components

__all__ = ["components"]
