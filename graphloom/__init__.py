"""graphloom: property-graph, text and record analytics as Spark DataFrame operators."""
