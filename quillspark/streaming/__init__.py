"""Transforms over streams."""
