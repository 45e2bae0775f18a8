"""Sources and sinks: traces, configurations, run logs, tables, checkpoints and generators."""
