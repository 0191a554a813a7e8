"""Sources and sinks: parameter sheets, test panels from the given tables, run history."""
