"""Queries over streams of files, with state that outlives a restart."""
