"""Column-to-Column functions; all stay inside JVM codegen unless stated."""
