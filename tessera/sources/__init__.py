"""Inputs: parsers, adapters and connectors that give quads or messages."""
