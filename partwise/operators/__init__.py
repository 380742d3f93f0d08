"""DataFrame operators: filters, entities, inference, distances, splits, metrics."""
