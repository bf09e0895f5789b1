"""One module for each family of queries; importing them registers the queries."""

from lumenmart.queries import analysis, claims, joins, kpi, layers, movement, scalars, scale, semantic, trust, wording  # noqa: F401
