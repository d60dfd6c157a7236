"""graphloom: property-graph, ranked-search and corpus analytics expressed on Spark DataFrames."""

__version__ = "0.1.0"
