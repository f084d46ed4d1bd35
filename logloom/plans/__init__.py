"""Stored state, the engine's API, and the registered queries."""
