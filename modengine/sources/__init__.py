"""Readers and writers of messages, word lists, user sets, violations and audit lines."""
