"""Record tables derived from the given tables."""

from pubmetrics.views.publications import COLUMNS, COUNTRIES, ORDER_KEYS, publications, table

__all__ = ["COLUMNS", "COUNTRIES", "ORDER_KEYS", "publications", "table"]
