"""Operations that a large training-data pipeline needs."""
