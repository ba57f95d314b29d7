"""Query and pipeline plans: SPARQL, mappings and component chains compiled to DataFrames."""
