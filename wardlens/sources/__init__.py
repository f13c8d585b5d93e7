"""Readers, writers, schemas and profiling."""
