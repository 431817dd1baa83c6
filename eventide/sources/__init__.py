"""eventide.sources"""
