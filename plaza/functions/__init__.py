"""plaza.functions"""
