"""Operators for preparing training corpora: deduplication, language, decontamination, archives, sharding and mixing."""
