"""taskloom.functions"""
