"""Fixed values of the stream format and the shared plan fragments."""
