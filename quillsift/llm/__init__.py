"""Operators of a training-data pipeline: packing, token files, secrets, URL and quality filters,
de-duplication, language-model scores and decontamination. Nothing else in the library imports this."""
