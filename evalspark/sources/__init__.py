"""Readers, validators, the run-log tables and the sinks."""
