"""Graph operators: functions from quads to quads."""
