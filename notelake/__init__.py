"""Spark-native analytics for timed, symbolic sequences."""

from . import catalog  # noqa: F401  (fills the registry of views)
