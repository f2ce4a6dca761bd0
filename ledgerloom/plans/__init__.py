"""Registered queries; importing this package registers them all."""

from . import fiscal, ingest, joins, notes, series, streams, text  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
