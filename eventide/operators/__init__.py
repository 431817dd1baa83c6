"""eventide.operators"""
