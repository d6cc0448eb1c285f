"""Registered queries over the driver tables, each with a check query where SQL can say it."""

from tallyworks.plans.registry import ORACLES, QUERIES  # noqa: F401
from tallyworks.plans import (  # noqa: F401
    actions,
    documents,
    files,
    forecasts,
    permits,
    procurement,
    product,
    retail,
    spatial,
)
