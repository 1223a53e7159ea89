"""eventlake.functions"""
