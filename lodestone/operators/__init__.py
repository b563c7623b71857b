"""Part of the search engine: operators."""
