"""Operators on streams, packets, spectra and samples: DataFrame in, DataFrame out."""
