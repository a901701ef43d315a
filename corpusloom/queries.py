"""All registered queries of the library."""

from .plans import analytics, assessment, changes, files, graphs, hierarchy, overview, processing, quality, search, similar, sources, structure, texts  # noqa: F401  each registers its queries
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
