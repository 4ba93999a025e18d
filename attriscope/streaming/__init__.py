from attriscope.streaming.roster import score_stream

__all__ = ["score_stream"]
