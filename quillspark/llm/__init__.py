"""Operators that prepare training data for language models; nothing else imports this package."""
