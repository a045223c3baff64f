"""All named queries, gathered from the catalog modules."""

from salesgrid.plans import (  # noqa: F401
    catalog_ingest,
    catalog_sales,
    catalog_series,
    catalog_text,
)
from salesgrid.plans.catalog_sales import flagship  # noqa: F401
from salesgrid.plans.registry import ORACLES, QUERIES  # noqa: F401
