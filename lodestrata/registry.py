"""All queries of the library's own operators, by the operator's number, and the same in SQL."""

from .plans import code, dialects, graphs, merging, reports, retrieval, scopes, sinks, texts, validation  # noqa: F401  they register their queries
from .plans.catalog import ORACLES, QUERIES  # noqa: F401
