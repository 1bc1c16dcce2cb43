"""Readers and writers: JSON, delimited text, line files, notebooks, transcripts, stores."""
