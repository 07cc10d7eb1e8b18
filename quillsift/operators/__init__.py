"""DataFrame transforms: data set preparation, features, models and report tables."""
