"""foliodex: indexing, searching and preparing document collections on Spark."""
