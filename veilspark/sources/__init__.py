"""Readers and writers of datasets in splits, delimited and fixed-width files, and metric reports."""
