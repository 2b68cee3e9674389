"""Offer intelligence as PySpark DataFrame transformations."""

from offerwise.params import Params

__all__ = ["Params"]
