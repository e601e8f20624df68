"""Plans made on the catalog before data is read."""
