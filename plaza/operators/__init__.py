"""plaza.operators"""
