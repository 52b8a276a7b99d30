"""All registered queries."""

from driftline.registry.base import ORACLE, QUERIES  # noqa: F401
from driftline.registry import sources, records, windowed, scoring, assessment, streams, flows, large  # noqa: F401,E402
