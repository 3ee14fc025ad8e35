"""corpusloom: a PySpark engine that prepares and evaluates speech- and text-aligned training data."""
