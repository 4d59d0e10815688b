"""plait.streaming"""
