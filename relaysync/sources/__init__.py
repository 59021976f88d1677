"""Sources and sinks: properties, event landing, the driver-table feed, sinks."""
