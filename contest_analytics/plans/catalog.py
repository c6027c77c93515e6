"""Imports every module that registers queries."""

from contest_analytics.plans import (  # noqa: F401
    embedding_queries,
    file_queries,
    leaderboard_queries,
    lookup_queries,
    preference_queries,
    series_queries,
    spectrum_queries,
    streaming_queries,
    submission_queries,
)
from contest_analytics.plans.registry import ORACLES, QUERIES  # noqa: F401
