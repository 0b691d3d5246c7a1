"""inkledger.operators"""
