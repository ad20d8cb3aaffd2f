"""Sources, demultiplexers and sinks: table functions that turn container bytes into rows, and a WAV data source."""
