"""Column functions work on streams as they are; records of a stream are blocked against a table or another stream by a join."""

from glyphweave.streaming.block import stream_block, stream_pairs

__all__ = ["stream_block", "stream_pairs"]
