"""Column functions: text normalization, tokenization, entities, numbers and schedules."""
