"""Whole tools as compositions of sources and operators."""
