"""threatloom.operators"""
