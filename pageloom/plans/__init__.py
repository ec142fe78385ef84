"""Every runnable query, one module per operator family."""

from pageloom.plans.registry import ORACLES, QUERIES  # noqa: F401
from pageloom.plans import aggregates, filters, functions, joins, lettering, masks, review, sources, streams, windows, workflow  # noqa: F401
