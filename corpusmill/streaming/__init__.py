"""Incremental and streaming processing."""
