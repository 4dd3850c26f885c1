"""Tremorframe: seismic event processing as Spark plans."""
