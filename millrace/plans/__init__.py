"""Statements: text to tokens, tokens to nodes, nodes to columns."""
