"""Named queries over the given tables, each with its ANSI SQL statement."""

from .catalog import catalog
from . import equations, exchange, library, quality, sqlcalls, streams, structure, texts, transcoding  # noqa: F401

__all__ = ["catalog"]
