"""Sources and sinks: documents in several file formats, JSON data sets, reports."""
