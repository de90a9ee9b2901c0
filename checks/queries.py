"""All registered queries; importing a module registers what it holds."""

from checks import queries_explore, queries_kpi, queries_load, queries_models, queries_stats  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
