"""What texts are read from and results are written to."""
