"""See the package docstring of crawlsched."""
