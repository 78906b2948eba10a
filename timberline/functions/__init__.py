"""Column functions (JVM-side expressions only)."""
