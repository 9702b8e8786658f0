"""Operators for building training corpora, each independent of the rest of the library."""
