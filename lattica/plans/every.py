"""The whole catalogue: importing this registers every query."""

from lattica.plans import evaluation, further, graphs, latent, monitoring, studies  # noqa: F401  they register their queries
from lattica.plans.catalog import QUERIES, SQL, entry_query

__all__ = ["QUERIES", "SQL", "entry_query"]
