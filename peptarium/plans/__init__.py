"""Declarative presets and multi-step jobs."""
