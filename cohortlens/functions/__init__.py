"""Column helpers: selection by schema, decoding, bands, labels."""

from cohortlens.functions.columns import (arrow_label, band, classify_by_prefix, cols_with_prefix,
                                          decode, decode_col, fill_nulls, filter_by,
                                          first_existing, keep_existing, match_regex, money_label,
                                          numeric_features, pct_label, percent_of, project, rename,
                                          round_cols, select_prefix, set_to_string, strip_prefixes,
                                          to_flags, truncate)

__all__ = ["arrow_label", "band", "classify_by_prefix", "cols_with_prefix", "decode",
           "decode_col", "fill_nulls", "filter_by", "first_existing", "keep_existing", "match_regex",
           "money_label", "numeric_features", "pct_label", "percent_of", "project", "rename",
           "round_cols", "select_prefix", "set_to_string", "strip_prefixes", "to_flags", "truncate"]
