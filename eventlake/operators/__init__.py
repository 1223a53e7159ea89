"""eventlake.operators"""
