"""DataFrame operators: guards, limits, scorers, model calls, votes, metrics."""
