"""Ball-by-ball sports analytics expressed as PySpark DataFrame operators."""

from creaseline.params import Params

__all__ = ["Params"]
