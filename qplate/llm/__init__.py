"""Operations of a training-data pipeline.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; inputs keep whatever extra columns they have, operators select the
columns they need, so clashing names cannot interfere.
"""
