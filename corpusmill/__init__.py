"""Corpus preparation and analytics on Spark: cleaning, tokenizer training, packing and checks as DataFrame operations."""
