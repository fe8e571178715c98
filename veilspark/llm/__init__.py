"""Operations for preparing large language-model training corpora.

Nothing else in the library imports this package; it may import the library's
general helpers.  Every operator takes and returns DataFrames.
"""
