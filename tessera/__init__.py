"""Tessera: dataset building, auditing and evaluation for ordered frame sequences, on Spark DataFrames."""

__version__ = "0.1.0"
