"""Operators for large training corpora: decontamination, exact and near deduplication, secret, license and
URL scans, quality and language-model scores, fingerprints and source mixing.

Nothing else in the package imports this folder.
"""
