"""cohortlens: survey and customer analytics as Spark DataFrame operators.

Every operator takes DataFrames plus parameters and returns a DataFrame, so
work stays lazy and is planned by Catalyst. Sub-packages:

* ``sources``   - readers, writers, table resolution, fixture views
* ``functions`` - column-level helpers (decode, bands, labels, schema walks)
* ``operators`` - aggregates, ranking, statistics, features, models, rules
* ``plans``     - composed reports and the query registry
* ``streaming`` - incremental variants of the KPI aggregates
"""

from cohortlens.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
__version__ = "0.1.0"
