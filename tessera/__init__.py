"""Tessera: retrieval, document processing and analytics as Spark plans."""
