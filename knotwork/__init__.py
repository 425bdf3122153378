"""knotwork: cohesive-subgraph analytics as PySpark DataFrame plans."""
