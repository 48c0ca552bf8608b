"""Readers that turn files, patches, manifests and payloads into tables."""
