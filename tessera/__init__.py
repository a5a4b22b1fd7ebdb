"""Tessera: blocked N-dimensional arrays as Spark relations."""
