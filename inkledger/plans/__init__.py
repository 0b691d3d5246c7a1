"""inkledger.plans"""
