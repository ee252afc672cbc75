"""Training-data operators for corpora of any size. Nothing else in visiloom imports this subpackage."""
