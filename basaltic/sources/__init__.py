"""Readers: fixed-schema tables, artefact files and binary adapters."""
