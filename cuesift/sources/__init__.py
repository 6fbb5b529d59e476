"""Readers and writers: file listings, text, subtitles, transcripts, tables."""
