"""Tokenizer families, encoding, batches and training."""
