"""Importing this module registers every query."""

from . import books, dynamics, fundamentals, live, market, model  # noqa: F401
