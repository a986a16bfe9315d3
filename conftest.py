"""Puts the repository on the path, whichever way pytest is called."""
