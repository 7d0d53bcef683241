"""Arborix: file-index, duplicate and corpus analytics as PySpark DataFrame operators."""
