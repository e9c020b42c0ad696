"""Operators for preparing training text at scale: scans, de-duplication,
classifiers, tokenization, extraction and language-model scoring.

Nothing else in the library imports this package.  ``queries`` holds the
registered queries; each operator has a module of its own."""
