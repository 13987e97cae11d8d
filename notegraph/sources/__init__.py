"""Readers and adapters that bring tables into the engine model."""
