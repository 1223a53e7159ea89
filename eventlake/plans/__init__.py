"""eventlake.plans"""
