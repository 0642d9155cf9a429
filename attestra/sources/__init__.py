"""Readers and writers of runs, archives and annotations."""
