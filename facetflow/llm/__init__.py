"""Training-data operators: tokenising, packing, extraction, search and de-duplication over document tables."""
