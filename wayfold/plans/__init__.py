"""Named queries over the tables, by section of the inventory."""

from . import aggregates, checks, classify, filters, graphs, index, joins, positions, scalar, storage, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
