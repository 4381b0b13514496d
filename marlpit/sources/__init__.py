"""Readers, and the adapters that give the supplied tables the shape of lecture tables."""
