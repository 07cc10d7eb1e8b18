"""Readers and writers for labelled texts, landed responses, stages and models."""
