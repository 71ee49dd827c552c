"""Training-data operators: filtering, deduplication, scoring, formatting and mixing of text corpora."""
