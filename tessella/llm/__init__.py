"""Training-data operators: tokenising, de-duplication, media, quality, privacy, archives, decontamination."""
