"""Operations of a training-data pipeline: search, dedup, scoring, tokens, packing, chat and media."""
