"""weftgraph: attributed-graph and similarity analytics as plain Spark DataFrame operations."""
