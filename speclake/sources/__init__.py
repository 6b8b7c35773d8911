"""Readers and writers of cubes, annotations and tables."""
