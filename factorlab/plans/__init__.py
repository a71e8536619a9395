"""Strategy choice and the registered queries."""
