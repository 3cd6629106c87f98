"""Streaming of marlstone."""
