"""DataFrame operators: filters, joins, aggregates, jurisdictions, graph and models."""
