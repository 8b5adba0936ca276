"""Operations of a training-data pipeline; see README for the list."""
