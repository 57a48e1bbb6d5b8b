"""Readers: Markdown corpora, tabular corpora, API descriptions, stored graphs."""
