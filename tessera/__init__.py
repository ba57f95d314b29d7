"""tessera: a Spark-native engine for RDF-style quads, event streams of members, and pipelines over them."""

__version__ = "0.1.0"
