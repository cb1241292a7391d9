"""Data quality: rules, scores, profiles, drift, duplicates, outliers."""
