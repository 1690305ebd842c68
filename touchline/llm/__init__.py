"""Training-data operators: near-dedup, quality, PII, licences, extraction,
mixing, packing and sharding.  Nothing else in the library imports this package."""
