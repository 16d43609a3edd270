"""Corpus operators for training data: scans, filters, de-duplication, tokens and chat rendering."""
