"""DataFrame operators: blocking, features, decisions, evaluation, profiling."""
