"""Readers, and views of the tables as decisions, paragraphs and chunks."""
