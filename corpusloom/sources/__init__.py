"""Readers and writers: keyed text tables, corpus formats, archives."""
