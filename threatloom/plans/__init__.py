"""threatloom.plans"""
