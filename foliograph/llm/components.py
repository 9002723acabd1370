"""Connected components, as the library has them."""

from ..operators.components import connected

__all__ = ["connected"]
