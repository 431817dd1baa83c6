"""eventide.plans"""
