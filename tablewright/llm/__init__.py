"""Operators for building training data: searching, chat text, token files, duplicates, quality, shards, secrets,
languages, mixing and benchmark leaks. Nothing else in the library imports this subpackage."""
