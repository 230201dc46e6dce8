"""Readers of case files, timelines and binary artifacts."""
