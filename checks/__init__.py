"""Queries over the test tables, each with its SQL twin where SQL can say it."""

from checks import catalog, files, health, mapping, media, profiles, signals  # noqa: F401
from checks.base import ORACLES, QUERIES  # noqa: F401
