"""Column-to-column functions. Every function takes and returns Columns and is null-safe."""
