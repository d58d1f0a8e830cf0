"""Readers: packets, raw frames, rule texts."""
