"""Training-data operators: near duplicates, token files, page text, language models, mixing and media."""
