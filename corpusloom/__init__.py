"""Document-corpus engine on Spark DataFrames.

Tables (or streams) of documents go in; cleaned, classified, chunked and
indexed tables come out, and whole batches of filtered top-k searches are
answered against them.
"""
