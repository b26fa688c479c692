"""Column functions; each returns a Column and stays in the JVM."""
