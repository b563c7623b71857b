"""Part of the search engine: plans."""
