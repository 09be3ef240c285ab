"""Sources and sinks: delimited text, XML, GeoJSON lines, plain text."""
