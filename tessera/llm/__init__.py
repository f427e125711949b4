"""Training-data operators: quality, WARC, tokenizers, PII, deduplication, decontamination, licences."""
