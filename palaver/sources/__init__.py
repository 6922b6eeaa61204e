"""Sources and sinks: the binary and the JSON-lines face of a container."""
