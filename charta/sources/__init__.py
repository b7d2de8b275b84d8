"""Schemas, loaders, connector registry, readers and sinks."""
