"""Readers and writers that turn bytes into rows and rows into bytes."""
