"""Readers and writers: file discovery and sampling, JSON lines, token files, tokenizer state."""
