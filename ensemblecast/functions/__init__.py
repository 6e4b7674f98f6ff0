"""Column builders: transforms, metrics, ranks and aggregates that stay in the JVM."""
