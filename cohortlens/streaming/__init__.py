"""Incremental variants of the KPI aggregates over file streams."""

from cohortlens.streaming.kpis import funnel_counts, read_responses, start_funnel, to_long

__all__ = ["funnel_counts", "read_responses", "start_funnel", "to_long"]
