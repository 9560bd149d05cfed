"""Plan choice and the registered queries."""
