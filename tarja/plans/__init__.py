"""Plans: the engine and the registry of queries."""
