"""Text and sequence operators for preparing training data; nothing else in the package imports this."""
