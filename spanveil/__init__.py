"""DataFrame operators that find, transform and audit sensitive data in text."""
