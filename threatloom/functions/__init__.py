"""threatloom.functions"""
