"""Sources and sinks: PDF files, page providers, the versioned index."""
