"""Operators that prepare language-model training data. Nothing outside this subpackage imports it."""
