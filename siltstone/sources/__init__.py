"""Readers of corpora, manifests, logs and registries."""
