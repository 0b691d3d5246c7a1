"""inkledger.sources"""
