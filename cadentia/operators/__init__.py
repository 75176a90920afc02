"""Operators on samples, intervals, beats, lag curves and offsets: DataFrame in, DataFrame out, keyed by session."""
