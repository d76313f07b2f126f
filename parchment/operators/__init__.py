"""Frames to frames: samples, aggregates, masks."""
