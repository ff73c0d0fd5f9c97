"""termgraph: knowledge-graph and corpus operators as Spark DataFrame plans."""
