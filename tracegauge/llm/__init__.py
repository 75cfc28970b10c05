"""Operators for text corpora: near and exact duplicates, decontamination, scoring, encoding and search."""
