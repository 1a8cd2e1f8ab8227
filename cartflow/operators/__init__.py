"""DataFrame -> DataFrame operators: features, evaluation, submission, baskets, profile, models."""
