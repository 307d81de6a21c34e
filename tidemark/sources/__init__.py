"""Readers and writers of log frames and metric text."""
