"""Readers, the sample, and the mapping of the driver's tables to trips."""
