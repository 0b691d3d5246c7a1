"""inkledger.streaming"""
