"""DataFrame -> DataFrame operators: aggregates, ranking, statistics,
features, classification, regression, clustering and association rules."""
