"""Parolumi."""
