"""inkledger.functions"""
