"""Training-data operators: tokenisation, language and quality models, deduplication, scans and filters."""
