"""Landed inputs and outputs."""
