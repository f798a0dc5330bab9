"""Registered queries and their SQL."""

from . import more_oracle, more_queries  # noqa: F401  they register theirs beside the first ones
