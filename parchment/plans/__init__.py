"""Query plans: derived views, assembled evaluation and the registry of queries."""
