"""Column expressions; all stay inside the JVM unless stated otherwise."""
