"""Imports every module that registers queries."""

from wicketflow.plans import innings_queries  # noqa: F401
from wicketflow.plans import player_queries  # noqa: F401
from wicketflow.plans import team_queries  # noqa: F401
from wicketflow.plans import score_queries  # noqa: F401
from wicketflow.plans import quality_queries  # noqa: F401
from wicketflow.plans import io_queries  # noqa: F401
from wicketflow.plans import merge_queries  # noqa: F401
from wicketflow.plans import detail_queries  # noqa: F401
from wicketflow.plans import record_queries  # noqa: F401
from wicketflow.plans import identity_queries  # noqa: F401
from wicketflow.plans import verify_queries  # noqa: F401
