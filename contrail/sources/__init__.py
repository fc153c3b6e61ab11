"""Readers and decoders that give the typed tables of the engine."""
