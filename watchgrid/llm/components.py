"""Connected components, as the core library finds them."""

from watchgrid.operators.graph import components

__all__ = ["components"]
