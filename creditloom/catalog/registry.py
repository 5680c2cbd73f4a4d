"""Imports every query module once, so that the registry is filled."""

from creditloom.catalog import binning, closed, files, fits, outputs, panel, report, stress, survive, validation  # noqa: F401
from creditloom.catalog.base import ORACLES, QUERIES  # noqa: F401
