"""Operations as a stream."""
