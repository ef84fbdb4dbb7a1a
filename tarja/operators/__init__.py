"""DataFrame operators: tables in texts, evaluation, training data."""
