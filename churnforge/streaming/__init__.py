from churnforge.streaming.scoring import score_stream, stream_table  # noqa: F401
