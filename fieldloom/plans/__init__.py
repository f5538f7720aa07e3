"""Plans over the supplied tables: views, named queries and whole flows."""
