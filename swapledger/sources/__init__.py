"""Readers, record normalisers, constant tables and writers."""
