"""All registered queries."""

from lectern.queries import boundaries, checks, decisions, evaluation, families, models, panel, readers, texts  # noqa: F401
from lectern.queries.registry import ORACLES, QUERIES  # noqa: F401
