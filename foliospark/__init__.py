"""Document-unit processing on Spark DataFrames.

Books, pages and page layouts go in as relations; translatable units, size
bounded batches, validation verdicts and rebuilt documents come out.
"""
