"""Readers and writers for telemetry, weather, catalogue and wide generation files."""
