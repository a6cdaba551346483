"""Agent-discovery analytics as PySpark DataFrame operators."""
