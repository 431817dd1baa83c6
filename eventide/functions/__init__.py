"""eventide.functions"""
