"""threatloom.streaming"""
