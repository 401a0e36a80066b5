"""Span analytics over text corpora: findings are interval rows, everything else is DataFrame operations on them."""
