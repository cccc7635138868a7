"""Marginals of streams (an extension: counts are additive; noise under continual release needs other accounting)."""
