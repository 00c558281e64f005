"""Streams.

There is no streaming operator of its own. Row-wise operators are fitted on a
batch and applied as expressions, so they take a streaming DataFrame as it is:
predicates, numeric transforms, text and date features, model prediction,
cluster assignment and isolation-forest scoring. The tests run them on a
stream.
"""
