"""Packrat parsing-expression grammars for source languages."""
