"""Plans: the planner facade and the catalogue of named queries with their SQL."""
