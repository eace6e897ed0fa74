"""Running streams: triggers, checkpoints, sinks and tables kept over a stream."""
