"""Registered queries over the test tables, each next to its SQL."""

from workload import features, messages, relational  # noqa: F401
from workload.registry import QUERIES, SQL  # noqa: F401
