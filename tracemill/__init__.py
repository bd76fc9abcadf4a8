"""Procedural-memory analytics over coding-agent session logs, as Spark DataFrame operators."""
