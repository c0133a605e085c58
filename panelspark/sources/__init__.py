"""Standard tables: contracts, readers, writers, importers, generators, providers."""
