"""graphloom: code-graph, retrieval and usage analytics expressed as Spark plans."""
