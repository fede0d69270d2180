"""Consent-gated curation of paired records, and request traffic around them, on PySpark."""
