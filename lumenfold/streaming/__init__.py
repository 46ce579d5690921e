"""Incremental reading of landed feeds; there are no stateful operators."""
