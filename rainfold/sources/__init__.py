"""Sources and sinks: table loading, fixture adapters, CSV I/O, report parsing."""
