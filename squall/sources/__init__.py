"""squall.sources"""
