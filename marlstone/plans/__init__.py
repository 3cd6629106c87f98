"""Plans of marlstone."""
