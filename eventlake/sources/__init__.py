"""eventlake.sources"""
