"""squall.plans"""
