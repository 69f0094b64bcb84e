"""Extension: the batch stages over a stream of samples."""
