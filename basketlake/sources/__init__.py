"""Readers, contracts and writers for transaction tables."""
