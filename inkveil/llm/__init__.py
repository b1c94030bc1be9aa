"""Operations of a training-data pipeline over a ``documents`` table.

Nothing outside this subpackage (but the guarded part of ``__spark_entry__``) imports it.
"""
