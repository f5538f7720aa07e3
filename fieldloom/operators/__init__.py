"""DataFrame-to-DataFrame operators, lazily composed."""
