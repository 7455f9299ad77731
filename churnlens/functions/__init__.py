"""Row-local column expressions: treatment, money text, captions, expected value and thresholds."""
