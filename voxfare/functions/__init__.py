from voxfare.functions import dates, scores, stats, text

__all__ = ["dates", "scores", "stats", "text"]
