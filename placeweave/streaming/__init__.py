"""Empty on purpose: the engine's data processing is batch only."""
