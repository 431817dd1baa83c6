"""eventide.streaming"""
