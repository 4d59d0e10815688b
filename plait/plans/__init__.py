"""plait.plans"""
