"""Inputs that both engines can build, and small planning helpers."""
