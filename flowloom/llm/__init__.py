"""Corpus-scale sketches and text operators. Nothing else in the library imports this subpackage."""
