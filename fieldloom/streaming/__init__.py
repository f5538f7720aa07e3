"""Incremental forms, each of which ends where its batch form does."""
