"""Operators on DataFrames: evaluation, retrieval, voting, histograms, batches, documents."""
