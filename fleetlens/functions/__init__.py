"""Column builders; every one stays inside JVM expressions."""
