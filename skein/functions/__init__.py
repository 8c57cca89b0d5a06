"""Column expressions: text, identifiers and vectors. All of them stay in the JVM."""
