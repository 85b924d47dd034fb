"""Operators of a training-data pipeline: packing, secret scans, quality, exact
substring removal, sharding, top-k search, url rules, near duplicates, language
identification and benchmark decontamination."""
