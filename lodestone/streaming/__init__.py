"""Part of the search engine: streaming."""
