"""Index tables, candidate expansion, search, maintenance and vectors."""
