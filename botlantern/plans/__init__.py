"""Plans: log parsing, table adapters and the catalogue of queries."""
