"""All registered queries and their checks."""

from corpuslake.plans import (  # noqa: F401  (importing registers)
    catalog_graph, catalog_maintain, catalog_retrieval, catalog_tables, catalog_text,
)
from corpuslake.plans.registry import ORACLES, QUERIES  # noqa: F401
