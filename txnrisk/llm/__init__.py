"""Operators for large text corpora: cleaning, near-duplicates, scoring, mixing and token output."""
