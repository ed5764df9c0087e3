"""Index operators. Relations are long, keyed by integer periods; a missing value is null."""
