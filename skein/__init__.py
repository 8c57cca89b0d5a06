"""skein: a PySpark engine for document graphs, evidence search and record resolution."""
