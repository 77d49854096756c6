from . import aggregates, cascades, filters, joins, lifecycle, sets, topk, windows  # noqa: F401
