"""Readers for landed files; each gives a good frame and a quarantine frame."""
