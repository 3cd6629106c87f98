"""Functions of marlstone."""
