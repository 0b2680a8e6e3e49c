"""Logical plans of the engine: one rotation, and batches of rotations."""
