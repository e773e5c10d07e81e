"""Readers, payload normalisers and write-once sinks."""
