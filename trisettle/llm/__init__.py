"""Operators that prepare text for training: near copies, language, tokens, personal data, quality, shards."""
