"""Agent-trajectory processing on Spark."""
