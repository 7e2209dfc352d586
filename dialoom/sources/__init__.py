"""Readers and writers of JSON lines, JSON arrays, prompts and growing result tables."""
