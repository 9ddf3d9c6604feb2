"""Corpus-preparation operators for training data (queries in ``queries``)."""
