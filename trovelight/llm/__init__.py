"""Operators that prepare texts for language-model training; nothing else imports this package."""
