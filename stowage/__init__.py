"""Multimedia archives, Kaldi archives and MIDI notes as Spark DataFrames."""

__version__ = "0.1.0"
