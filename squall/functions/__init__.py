"""squall.functions"""
