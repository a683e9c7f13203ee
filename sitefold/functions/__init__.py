"""Column expressions: URLs, text extraction, scores and costs."""
