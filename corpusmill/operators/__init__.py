"""Relational operators of the corpus pipeline: counts, tokenizer, offsets, windows, chats, samples, reports, kernels."""
