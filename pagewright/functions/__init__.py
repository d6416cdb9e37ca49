"""Column expressions: URLs, text, HTML, scoring."""
