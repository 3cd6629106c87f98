"""Operators of marlstone."""
