"""The catalogue of named queries; importing its modules fills it."""

from . import episodes, files, maps, models, scenes  # noqa: F401
from .catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
