"""eventlake.streaming"""
