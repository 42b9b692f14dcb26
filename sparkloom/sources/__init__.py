"""sparkloom.sources"""
