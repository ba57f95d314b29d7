"""Outputs: serialisers and writers."""
