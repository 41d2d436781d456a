"""Relational, graph, history and write-path operators over the statement table."""
