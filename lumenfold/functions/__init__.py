"""Column functions: no joins, no actions, nothing outside the JVM."""
