"""The registered queries: each reads the given tables whole and has an id,
a Spark form and, where SQL can express it, a DuckDB form of the same rows."""
