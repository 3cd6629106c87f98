"""Sources of marlstone."""
