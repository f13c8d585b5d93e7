"""Operators for preparing language-model training data at scale; nothing else imports this package."""
