"""Parolumi: evaluation analytics and data preparation as Spark plans."""
