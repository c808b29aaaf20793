"""Readers and writers of matrices, index tables and run outputs."""
