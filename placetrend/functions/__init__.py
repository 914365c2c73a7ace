"""Column-level functions; all stay inside the JVM."""
