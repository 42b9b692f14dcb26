"""sparkloom.plans"""
