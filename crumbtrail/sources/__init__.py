"""Readers: crawl documents, site lists, filter lists, tracker services and result tables."""
