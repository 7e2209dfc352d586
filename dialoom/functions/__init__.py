"""Column functions on texts, replies, profiles and chat records."""
