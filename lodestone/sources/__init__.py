"""Part of the search engine: sources."""
