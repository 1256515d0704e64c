"""Named queries and the SQL they are held against."""

from tidewire.plans import io_plans, link_plans, rank_plans, report_plans, score_plans, stat_plans, state_plans, text_plans  # noqa: F401  (they register their queries)
from tidewire.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
