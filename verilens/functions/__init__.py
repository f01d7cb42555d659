"""Column-level building blocks. Everything here returns a Column and runs in the JVM."""
