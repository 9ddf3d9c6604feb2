"""Readers, writers, table resolution and fixture views."""

from cohortlens.sources.io import (TABLES, flatten_for_text, load_pipeline, nan_to_null,
                                   read_csv, read_table, resolve_source, save_pipeline,
                                   table_shape, write_csv, write_results)
from cohortlens.sources.views import BASKET_ITEMS, basket, profile, register_views

__all__ = ["TABLES", "flatten_for_text", "load_pipeline", "nan_to_null", "read_csv",
           "read_table", "resolve_source", "save_pipeline", "table_shape", "write_csv",
           "write_results", "BASKET_ITEMS", "basket", "profile", "register_views"]
