"""threatloom.sources"""
