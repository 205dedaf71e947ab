"""Sources and sinks: files, the data source, renderers, preset tables, command line."""
