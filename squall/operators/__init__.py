"""squall.operators"""
